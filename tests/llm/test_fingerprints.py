"""Weighted fingerprints against exact similarities and a plain version of the edit."""

from __future__ import annotations

import random
from collections import Counter
from hashlib import sha256

import numpy as np
import pytest

from obsspark.llm import fingerprints, shingles
from obsspark.llm.shingles import word_hashes, word_runs
from tests.llm.edge import edge_docs, empty_docs, prose, rows


def _terms(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    return Counter(words) + Counter(zip(words, words[1:], strict=False))


def _jaccard(a, b):
    a, b = _terms(a), _terms(b)
    return sum((a & b).values()) / sum((a | b).values()) if a or b else 1.0


def _expected(docs):
    """{doc_id: (text, edited, next)}; ids differ."""
    order = sorted(docs, key=lambda d: (d[0] is None, -(d[0] or 0)))
    out = {}
    for (i, text), (_, following) in zip(order, order[1:] + order[:1], strict=True):
        n = len(text) // 3
        out[i] = text, text[:len(text) - n] + following[:n], following
    return out


def _check(got, want):
    assert sorted(r.doc_id or -1 for r in got) == sorted(i or -1 for i in want)
    errors = []
    for r in got:
        text, changed, following = want[r.doc_id]
        assert (r.n_chars, r.edited_sha256) == (len(text), sha256(changed.encode()).hexdigest())
        for near, other in ((r.near_edited, changed), (r.near_next, following)):
            assert 0 <= near <= 1
            errors.append(near - _jaccard(text, other))
    for a in got:
        for b in got:
            if want[a.doc_id][0] == want[b.doc_id][0]:
                assert a.fingerprint == b.fingerprint
    assert max(map(abs, errors)) < 0.3 and abs(np.mean(errors)) < 0.03
    assert all(len(r.fingerprint) == len(r.edited_fingerprint) == 4 * fingerprints.SAMPLES for r in got)


@pytest.mark.parametrize("block", [fingerprints.TEXT_BYTES, 100])
def test_edits_and_likeness(spark, monkeypatch, block):
    monkeypatch.setattr(fingerprints, "TEXT_BYTES", block)
    docs = [(3 * i, prose(i % 50, 1 + i * i % 400)) for i in range(120)] + [(1, ""), (2, "  "), (5, "é👍" * 10), (None, prose(3, 30))]
    df = spark.createDataFrame([(*d, "x", 1) for d in docs], "doc_id long, text string, part string, place int").repartition(5)
    _check(fingerprints.weighted_fingerprints(df).collect(), _expected(docs))


def test_likeness_is_the_generalised_jaccard_similarity():
    r = np.random.default_rng(1)
    errors = []
    for _ in range(40):
        n = int(r.integers(3, 300))
        a = r.integers(1, 6, n)
        b = np.where(r.random(n) < r.random(), a, r.integers(0, 9, n))
        keys = r.integers(0, 2**63, n).astype(np.uint64)
        offsets = np.array([0, n, n + (b > 0).sum()])
        s = fingerprints.sampled(offsets, np.concatenate([keys, keys[b > 0]]), np.concatenate([a, b[b > 0]]), 1024)
        errors.append(fingerprints.likeness(s[:1], s[1:])[0] - np.minimum(a, b).sum() / np.maximum(a, b).sum())
    assert abs(np.mean(errors)) < 0.006 and np.sqrt(np.mean(np.square(errors))) < 0.02


def test_rows_that_repeat(spark):
    """A third of all rows are one row; ids repeat with other texts."""
    docs = [(i, prose(i, 20)) for i in range(40)] + [(7, "the same row again and again")] * 25 + [(None, "no id")] * 5
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(6)
    got = fingerprints.weighted_fingerprints(df).collect()
    assert Counter(r.doc_id for r in got) == Counter(i for i, _ in docs)
    same = [r for r in got if r.n_chars == 28]
    assert len(same) == 25 and sum(r.near_next == 1 for r in same) == 24 and len({r.fingerprint for r in same}) == 1
    key = [tuple(r) for r in got]
    again = [tuple(r) for r in fingerprints.weighted_fingerprints(df.repartition(2)).collect()]
    assert sorted(key, key=str) == sorted(again, key=str)


def test_lone_document_and_none(spark):
    one = spark.createDataFrame([(4, "a lone text")], "doc_id long, text string")
    r = fingerprints.weighted_fingerprints(one).collect()[0]
    assert r.edited_sha256 == sha256(b"a lone ta l").hexdigest() and r.near_next == 1
    assert fingerprints.weighted_fingerprints(empty_docs(spark)).collect() == []


def test_awkward_documents(spark):
    got = fingerprints.weighted_fingerprints(edge_docs(spark)).collect()
    assert Counter(r.doc_id for r in got) == Counter(d for d, *_ in rows())
    texts = {d: t or "" for d, t, *_ in rows() if d not in (None, 2)}
    assert all(r.n_chars == len(texts[r.doc_id]) for r in got if r.doc_id in texts)
    by = {r.doc_id: r for r in got}
    assert by[1].fingerprint == by[13].fingerprint and by[4].fingerprint == by[5].fingerprint == "0" * 4 * fingerprints.SAMPLES


def test_long_texts_are_hashed_in_pieces(monkeypatch):
    text = ("  Some words " + "x" * 50 + "\ty ").encode() * 30
    whole = word_hashes(text)
    for size in (1, 7, 64, 1 << 18):
        monkeypatch.setattr(shingles, "BLOCK_BYTES", size)
        assert (word_runs(text) == whole).all()
    assert len(word_runs(b" " * 20)) == 0


def test_terms_are_sampled_alike_in_blocks(monkeypatch):
    texts = [prose(i, random.Random(i).randrange(300)).encode() for i in range(20)]
    whole = fingerprints.sampled(*fingerprints.weighted_terms(texts))
    monkeypatch.setattr(fingerprints, "TERMS", 37)
    assert (fingerprints.sampled(*fingerprints.weighted_terms(texts)) == whole).all()


def test_pairs_are_sampled_as_each_text_alone(monkeypatch):
    texts = [prose(i, i * 7 % 90) for i in range(30)] + ["", "one", " "]
    others = [fingerprints.edited(t, n) for t, n in zip(texts, texts[1:] + texts[:1], strict=True)]
    monkeypatch.setattr(fingerprints, "TEXT_BYTES", 500)
    a, b = fingerprints.paired(texts, others)
    assert (a == fingerprints.fingerprints(texts)).all() and (b == fingerprints.fingerprints(others)).all()
