"""Prefix trie and spelling variants against brute-force versions on made-up rows."""

from __future__ import annotations

import random
from collections import Counter, defaultdict
from hashlib import sha256
from zlib import crc32

import numpy as np
import pytest

from obsspark.llm import prefix_trie, spelling
from tests.llm.edge import edge_docs, empty_docs, prose, rows

TURNS = "conv_id long, turn long, role string, text string, key string, n long, keys string, depth int"


def _expected_trie(turns):
    by = defaultdict(list)
    for c, turn, role, text in turns:
        if c is not None:
            by[c].append((turn is not None, turn or 0, role or "", text or ""))
    own = {c: [(r, t) for *_, r, t in sorted(v, key=lambda x: x[:2])] for c, v in by.items()}
    whole = {}
    for c, v in own.items():
        h = crc32(str(c).encode()) % 6
        whole[c] = own.get(c - int(np.fmod(c, 100)), [])[:h] + v[h:]
    nodes = defaultdict(list)
    for c, v in whole.items():
        for d in range(len(v) + 1):
            nodes[tuple(v[:d])].append(c)
    children = Counter(k[:-1] for k in nodes if k)
    leaves, saved = Counter(), Counter()
    for k, members in nodes.items():
        for d in range(len(k) + 1):
            leaves[k[:d]] += children[k] == 0
            saved[k[:d]] += (len(members) - 1) * len(k[-1][1]) if k else 0
    out = []
    for k, members in nodes.items():
        ends = ",".join(str(c) for c in sorted(members) if len(whole[c]) == len(k))
        out.append((min(members), len(k), min(nodes[k[:-1]]) if k else -1, len(members), children[k], leaves[k], saved[k],
                    sha256(ends.encode()).hexdigest()))
    return sorted(out)


def _trie(spark, turns):
    df = spark.createDataFrame([(*t, "k", 1, "x", 2) for t in turns], TURNS).repartition(3)
    return sorted((r.conv_id, r.depth, -1 if r.parent_conv_id is None else r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves,
                   r.saved_tokens, r.ends_sha256) for r in prefix_trie.prefix_trie(df).collect())


def _conversations(seed):
    r = random.Random(seed)
    out = []
    for c in [*range(-3, 60), *range(100, 160), 205, 207, 333, 1000, 1003]:
        # most open alike, many are copies, one is a prefix of another, a few are long
        length = r.choice((1, 2, 3, 4, 9)) if c % 50 else 70
        for t in range(length):
            out.append((c, t, ("user", "assistant")[t % 2], f"turn {t} {r.choice('ab') if t > 2 and c % 3 else ''}" + "é漢👍" * (t % 2)))
    out += [(3000, None, None, None), (3000, 5, "user", ""), (None, 0, "user", "no id"), (3100, 1, "user", "x" * 20000), (3199, 0, "user", "short")]
    # told apart by the turn's border, not by its joined characters
    out += [(4000, i, "u", "ab") for i in range(8)] + [(4001, i, "ua", "b") for i in range(8)]
    return out


@pytest.mark.parametrize("group", [prefix_trie.GROUP_TURNS, 40, 0])
def test_trie_against_brute_force(spark, monkeypatch, group):
    """Whole subtrees in tasks, small groups, and every depth regrouped."""
    monkeypatch.setattr(prefix_trie, "GROUP_TURNS", group)
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 3)
    monkeypatch.setattr(prefix_trie, "MANY_CHILDREN", 2)
    turns = _conversations(1)
    assert _trie(spark, turns) == _expected_trie(turns)


def test_one_conversation_that_a_third_of_all_are_copies_of(spark, monkeypatch):
    monkeypatch.setattr(prefix_trie, "PIECE_IDS", 7)
    turns = [(100 * c, t, "user", f"{t}" if c % 3 == 0 else f"{t} {c}") for c in range(150) for t in range(3)]
    got = _trie(spark, turns)
    assert got == _expected_trie(turns)
    assert max(n for _, d, _, n, *_ in got if d == 3) == 50


def test_trie_of_nothing(spark):
    df = spark.createDataFrame([], TURNS)
    assert prefix_trie.prefix_trie(df).collect() == []
    assert _trie(spark, [(None, 1, "user", "x")]) == []


def test_trie_is_the_same_in_any_order_of_equal_turns(spark):
    one, two = [c for c in range(1, 100) if crc32(str(c).encode()) % 6 == 0][:2]
    turns = [(one, 1, "user", t) for t in "abc"] + [(two, 1, "user", t) for t in "cab"]
    got = _trie(spark, turns)
    assert _trie(spark, turns[::-1]) == got
    assert [n for _, d, _, n, *_ in got if d == 3] == [2]


def _expected_words(docs):
    counts = Counter()
    for doc_id, text in docs:
        lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
        run = ""
        for c in lowered + " ":
            if "a" <= c <= "z" or "À" <= c <= "ÿ":
                run += c
            elif run:
                h = crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
                counts[run if h % 97 else run[:h % len(run)] + run[h % len(run) + 1:]] += 1
                run = ""
    n = {w: k for w, k in counts.items() if len(w) >= 5 and k >= 3}

    def one_edit(a, b):
        if len(a) > len(b):
            a, b = b, a
        if len(a) == len(b):
            return sum(x != y for x, y in zip(a, b, strict=True)) == 1
        return len(a) + 1 == len(b) and any(b[:i] + b[i + 1:] == a for i in range(len(b)))

    form, near = {}, {}
    for w in n:
        others = [o for o in n if one_edit(w, o)]
        near[w] = len(others)
        best = min(others, key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None
    out = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.append((w, form[w] or "", root, n[w], near[w], n.get(form[w], -1)))
    return sorted(out)


def _words(df):
    return sorted((r.word, r.form or "", r.root, r.n, r.n_near, -1 if r.form_n is None else r.form_n) for r in spelling.spelling_variants(df).collect())


def _variants(seed):
    r = random.Random(seed)
    out = []
    for i in range(300):
        words = []
        for _ in range(40):
            w = list(r.choice(("colour", "neighbour", "éèçàùî", "recieve", "letter", "bookkeeper", "aaaaaa")))
            for _ in range(r.choice((0, 0, 0, 1, 1, 2))):
                at = r.randrange(len(w))
                w[at:at + r.choice((0, 1))] = r.choice(("", "x", "é", w[at], "Q"))
                w = w or ["z"]
            words.append("".join(w))
        out.append((None if i % 30 == 0 else i % 250, " ".join(words)))
    return out


def test_variants_against_all_pairs(spark):
    docs = _variants(3)
    # a third of all rows are one text
    docs += [(1000 + i, docs[0][1]) for i in range(150)]
    df = spark.createDataFrame([(*d, "x", 1, 2, "k") for d in docs], "doc_id long, text string, word string, n long, key long, near string").repartition(4)
    want = _expected_words(docs)
    assert _words(df) == want and any(f for _, f, *_ in want)
    assert any(root not in (w, f) for w, f, root, *_ in want)


def test_few_and_many_symbols_give_the_same(spark):
    df = spark.createDataFrame(_variants(4), "doc_id long, text string")
    got = [sorted(map(tuple, spelling.spelling_variants(df, symbols=s).collect()), key=str) for s in (2, 31)]
    assert got[0] == got[1]


def test_awkward_documents(spark):
    docs = [(d, t) for d, t, *_ in rows()]
    assert _words(edge_docs(spark)) == _expected_words(docs)
    assert _words(empty_docs(spark)) == []


def test_long_words_are_taken_in_blocks(spark, monkeypatch):
    word = "".join(random.Random(5).choice("abcdefgh") for _ in range(4000))
    texts = [word] * 6 + [word[:2000] + word[2001:]] * 3 + [word + "q"] * 3
    docs = [(i, t + " " + prose(i, 3)) for i, t in enumerate(texts)]
    monkeypatch.setattr(spelling, "CELLS", 5000)
    got = {w: (f, near) for w, f, _, _, near, _ in _words(spark.createDataFrame(docs, "doc_id long, text string")) if len(w) > 3000}
    marked = Counter(spelling.marked(i, t) for i, t in enumerate(texts))
    assert got[word] == ("", sum(k >= 3 and w != word for w, k in marked.items())) and len(got) > 1


def test_reduced_neighbourhood_is_whole():
    """The keys of a word's neighbourhood are those of all strings at most one edit away over the symbols."""
    words = ["abcde", "aaaaa", "éabcz"]
    codes = spelling.reduced_codes(words, 3)
    row, key = spelling.neighbour_keys(codes, 3, lambda k: np.ones(k.shape, dtype=bool))
    for i, code in enumerate(codes.tolist()):
        want = {tuple(code)}
        for p in range(len(code) + 1):
            want |= {tuple(code[:p] + [s] + code[p:]) for s in (1, 2, 3)}
            if p < len(code):
                want.add(tuple(code[:p] + code[p + 1:]))
                want |= {tuple(code[:p] + [s] + code[p + 1:]) for s in (1, 2, 3)}
        keys = {int(spelling.form_keys(np.array([w], dtype=np.uint64))[0]) for w in want}
        assert {int(k) for k in key[row == i]} == keys and len(keys) == len(want)
