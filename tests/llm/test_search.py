from __future__ import annotations

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsspark.llm import near_dedup, revisits, topk
from obsspark.llm.graph import components
from obsspark.llm.lsh_forest import exact_links, spanning_forest
from obsspark.llm.shingles import shingle_sets
from tests.llm.edge import edge_docs, empty_docs, prose, rows


def _shingles(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        lowered = lowered.replace(c, " ")
    words = [w for w in lowered.split(" ") if w]
    return {tuple(words[i:i + 5]) for i in range(max(1, len(words) - 4))} if words else set()


def _expected(docs):
    """(number of shingles, smallest doc_id reachable) per row, by comparing all pairs."""
    sets = [_shingles(t) for _, t in docs]
    root = list(range(len(docs)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(docs)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = defaultdict(list)
    for i in range(len(docs)):
        groups[find(i)].append(docs[i][0])
    least = {k: min((d for d in v if d is not None), default=None) for k, v in groups.items()}
    return sorted((d or -1, len(sets[i]), least[find(i)] or -1) for i, (d, _) in enumerate(docs))


def test_shingle_hashes_stand_for_word_sequences():
    texts = ["a b c d e f", "A  b\tc d\ne f", "a b c d", "a b c d e", "", "  ", "ab c", "a bc", "é É ß", "x " * 40]
    sets = []
    for _, offsets, hashes in shingle_sets([t.encode() for t in texts]):
        sets += [frozenset(hashes[offsets[i]:offsets[i + 1]].tolist()) for i in range(len(offsets) - 1)]
    assert [len(s) for s in sets] == [len(_shingles(t)) for t in texts]
    for i, a in enumerate(texts):
        for j, b in enumerate(texts):
            assert (sets[i] == sets[j]) == (_shingles(a) == _shingles(b))


@pytest.mark.parametrize("region", [near_dedup.REGION, 12])
def test_near_duplicates_against_all_pairs(spark, region):
    """A large group of near copies, others of two, and a passage that many share; also with
    regions so small that they are taken deeper and dealt into parts."""
    r = random.Random(11)
    docs = [(d, t) for d, t, *_ in rows()]
    base, passage = prose(900, 120).split(), prose(901, 30)
    for i in range(60):
        words = list(base)
        for at in r.sample(range(120), r.randrange(7)):
            words[at] = f"w{r.randrange(10 ** 6)}"
        docs.append((2000 + i, " ".join(words)))
    for i in range(30):
        docs.append((3000 + i, prose(3000 + i, 20 + i) + " " + passage))
        docs.append((4000 - i, prose(3000 + i, 20 + i).replace(" ", "\n") + "  " + passage + (" more" if i % 2 else "")))
    table = spark.createDataFrame(docs, "doc_id long, text string").repartition(4)
    got = near_dedup.near_duplicates(table, region).collect()
    assert sorted((x.doc_id or -1, x.n_shingles, x.component_id or -1) for x in got) == _expected(docs)
    assert all(x.kept == (x.doc_id is None or x.doc_id == x.component_id) for x in got)


def test_pairs_behind_a_shared_template_are_all_found(spark):
    """A template in 5,000 documents makes regions too large; 200 pairs have a similarity of 0.75 to 0.8."""
    template = prose(77, 80)
    docs, want = [], {}
    for i in range(5000):
        twin = 4800 <= i
        own = [f"u{i - 200 if twin else i}x{k}" for k in range(20)]
        if twin:
            own[-11 - i % 3:] = [f"v{i}x{k}" for k in range(11 + i % 3)]
        docs.append((i, template + " " + " ".join(own)))
        want[i] = i - 200 if twin else i
    for a, b in ((4600, 4800), (4601, 4801), (4602, 4802)):
        x, y = _shingles(docs[a][1]), _shingles(docs[b][1])
        assert 0.75 <= len(x & y) / len(x | y) <= 0.8
    got = near_dedup.near_duplicates(spark.createDataFrame(docs, "doc_id long, text string").repartition(4), 64).collect()
    assert {x.doc_id: x.component_id for x in got} == want


def test_crowded_pairs_with_common_shingles_in_blocks(spark):
    """Blocks of two: a large component, others, and shingles that all share; every link across components is a pair."""
    r = np.random.default_rng(3)
    sets = [np.sort(r.choice(20, 12 + i % 5, replace=False).astype(np.int64)) for i in range(60)]
    comp = [0 if i < 20 else i for i in range(60)]
    table = spark.createDataFrame([(i, c, bytearray(s.tobytes())) for i, (c, s) in enumerate(zip(comp, sets, strict=True))],
                                  "cid long, comp long, hashes binary")
    both = lambda i, j: len(np.intersect1d(sets[i], sets[j]))
    links = {(i, j) for i in range(60) for j in range(i + 1, 60) if comp[i] != comp[j]
             and 100 * both(i, j) >= 75 * (len(sets[i]) + len(sets[j]) - both(i, j))}
    for block in (2, 1024):
        got = [(x.a, x.b) for x in near_dedup.crowded_pairs(table, block).collect()]
        assert len(got) == len(set(got)) and links and links <= set(got)


def test_near_dropping_keeps_columns(spark):
    docs = edge_docs(spark)
    got = near_dedup.drop_near_duplicates(docs)
    assert got.columns == docs.columns
    want = {d for d, _, least in _expected([(d, t) for d, t, *_ in rows()]) if d == least and d > 0}
    assert {r.doc_id for r in got.collect() if r.doc_id is not None} == want
    assert near_dedup.near_duplicates(empty_docs(spark)).count() == 0


def test_components_of_paths_stars_and_rings(spark):
    r = random.Random(5)
    names = r.sample(range(10 ** 6), 300)
    edges = [(names[i], names[i + 1]) for i in range(99)] + [(names[100], names[i]) for i in range(101, 200)]
    edges += [(names[200 + i], names[200 + (i + 1) % 100]) for i in range(100)]
    got = components(spark.createDataFrame(edges, "a long, b long")).collect()
    groups = defaultdict(set)
    for x in got:
        groups[x.root].add(x.node)
    assert sorted(map(sorted, groups.values())) == sorted(map(sorted, (names[:100], names[100:200], names[200:])))
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_forest_and_exact_links():
    i, j = np.array([0, 0, 1, 3]), np.array([1, 2, 2, 4])
    edges, comp = spanning_forest(6, i, j, np.array([0.9, 0.8, 0.95, 0.7]))
    assert sorted(edges.tolist()) == [0, 2, 3] and comp.tolist() == [0, 0, 0, 3, 3, 5]
    sets = [np.array(x, dtype=np.uint64) for x in ([1, 2, 3, 4], [1, 2, 3], [1, 2, 3, 4], [7])]
    a, b = exact_links(np.array([5, 5, 6, 6]), np.arange(4), sets, 75)
    assert list(zip(a, b, strict=True)) == [(0, 1)]


def _brute(vectors, k):
    ok = [(n, v, np.floor(256 * np.array(x, dtype=np.float32).astype(float))) for n, (v, x) in enumerate(vectors)
          if x and all(c is not None and np.isfinite(np.float32(c)) for c in x)]
    out = []
    for n, v, q in ok:
        if v is not None and v % 50 == 0:
            near = sorted(((-int(sum(int(a) * int(b) for a, b in zip(q, c, strict=True))), -1 if w is None else w) for m, w, c in ok if m != n and len(c) == len(q)))
            out += [(v, rank, w, -s) for rank, (s, w) in enumerate(near[:k], 1)]
    return sorted(out)


def test_top_k_against_brute_force(spark, monkeypatch):
    r = np.random.default_rng(2)
    vectors = [(i, [float(x) for x in r.normal(0, 0.2, 40)]) for i in range(700)]
    vectors += [(700 + i, vectors[i][1]) for i in range(60)]  # ties
    vectors += [(900, None), (901, []), (950, [float("nan")] * 40), (951, [None, *vectors[0][1][1:]]), (952, [float("inf")] * 40), (None, vectors[3][1]),
                (1000, vectors[1][1]), (1000, vectors[1][1]), (1050, [1.0, 2.0]), (1051, [0.5, 0.25]), (1100, [1.0])]
    table = spark.createDataFrame([(v, x, 7, 1) for v, x in vectors], "vec_id long, embedding array<float>, rank int, score int").repartition(3)
    monkeypatch.setattr(topk, "QUERIES", 8)
    monkeypatch.setattr(topk, "CANDIDATES", 64)
    got = topk.top_k(table, F.col("vec_id") % 50 == 0).collect()
    assert sorted((r.query_id, r.rank, -1 if r.vec_id is None else r.vec_id, r.score) for r in got) == _brute(vectors, 5)
    assert topk.top_k(table.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_top_k_of_large_components_is_exact():
    big = np.array([[2 ** 40, -(2 ** 40)], [3, 5]], dtype=object)
    own = np.zeros((2, 2), dtype=bool)
    i, j, score = topk.best_of_blocks(big, big, own, np.array([1, 2]), 2, np.full(2, -np.inf))
    assert [int(s) for s in score] == [2 ** 80 + 9, -(2 ** 80) + 15, 2 ** 80 + 25, -(2 ** 80) + 15] and list(i) == [0, 0, 1, 1]


def _resolve(captures):
    out = {}
    for rid, key, ts, revisit, etag, changed, _ in captures:
        if not revisit:
            continue
        earlier = [c for c in captures if not c[3] and key is not None and c[1] == key and ts is not None and c[2] is not None and c[2] < ts]
        if not earlier:
            out[rid] = (None, "missing")
            continue
        full = max(earlier, key=lambda c: (c[2], c[0]))
        if etag is not None and full[4] is not None:
            state = "resolved" if etag.removeprefix("W/") == full[4].removeprefix("W/") else "mismatch"
        elif changed is not None and full[5] is not None:
            state = "resolved" if changed == full[5] else "mismatch"
        else:
            state = "unvalidated"
        out[rid] = (full[0] if state != "mismatch" else None, state)
    return out


def test_header_names_have_no_case(spark):
    """A 304 replaces a header whatever its case, never the body's; of names that differ in case alone the last one stays."""
    stored = {"Content-Type": "text/html", "content-length": "5", "Cache-Control": "max-age=60", "ETag": '"a"', "X-One": "1", "x-one": "2"}
    again = {"Content-Length": "0", "CONTENT-TYPE": "text/plain", "cache-control": "no-cache", "Date": "now", "TE": "gzip"}
    rows = [(1, "http://a/", 1, False, '"a"', None, stored), (2, "http://a/", 2, True, '"a"', None, again), (3, "http://a/", 3, True, '"a"', None, None)]
    table = spark.createDataFrame(rows, "record_id long, url string, ts long, revisit boolean, etag string, last_modified string, headers map<string,string>")
    got = {x.record_id: x.headers for x in revisits.resolve_revisits(table).collect()}
    kept = ["content-length: 5", "content-type: text/html", 'etag: "a"', "x-one: 2"]
    assert got[2].split("\n") == sorted([*kept, "cache-control: no-cache", "date: now"])
    assert got[3].split("\n") == sorted([*kept, "cache-control: max-age=60"])


def test_revisits_against_a_loop_with_a_hot_url(spark):
    r = random.Random(8)
    caps = []
    for i in range(900):
        url = "hot.example/a" if i % 3 else f"u{r.randrange(40)}.example/p"
        tag = r.choice([None, '"a"', '"b"', 'W/"a"'])
        caps.append((i, None if i % 90 == 1 else url, None if i % 70 == 3 else r.randrange(400), r.random() < 0.5, tag, r.choice([None, "x", "y"]),
                     None if i % 50 == 0 else {"etag": str(i), "content-length": str(i)}))
    table = spark.createDataFrame([(a, u and "HTTP://" + u.replace("hot", "HOT") + "/?utm_x=1#f", *rest, "html") for a, u, *rest in caps],
                                  "record_id long, url string, ts long, revisit boolean, etag string, last_modified string, headers map<string,string>, key string")
    got = {x.record_id: x for x in revisits.resolve_revisits(table).collect()}
    want = _resolve([(a, u, *rest) for a, u, *rest in caps])
    assert {k: (x.response_id, x.state) for k, x in got.items()} == want
    headers = {c[0]: c[6] or {} for c in caps}
    for k, x in got.items():
        if x.response_id is not None:
            merged = headers[x.response_id] | {n: v for n, v in headers[k].items() if n != "content-length"}
            assert x.headers == "\n".join(f"{n}: {merged[n]}" for n in sorted(merged))
    assert revisits.resolve_revisits(table.limit(0)).count() == 0


def test_canonical_urls(spark):
    urls = {"http://WWW.Example.com:80/a/?b=2&utm_source=x&a=1#top": "www.example.com/a?a=1&b=2", "https://e.org": "e.org", "https://e.org/": "e.org",
            "https://e.org:443/x?": "e.org/x", " http://e.org/x//": "e.org/x", "https://e.org:8080/A?q": "e.org:8080/A?q", "no scheme#x": "no scheme", None: None}
    got = spark.createDataFrame([(u,) for u in urls], "url string").select("url", revisits.canonical_url(F.col("url")).alias("c")).collect()
    assert {r.url: r.c for r in got} == urls
