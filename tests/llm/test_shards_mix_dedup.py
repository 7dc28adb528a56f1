from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from obsspark.llm import exact_dedup, kd_shards, mixing
from tests.llm.edge import edge_docs, empty_docs, prose, rows

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def _counter(found):
    return Counter(tuple(r) for r in found)


def test_shards_hold_every_row_once_with_gapless_slots(spark):
    got = kd_shards.shard_rows(edge_docs(spark), shards=5).collect()
    want = Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t, *_ in rows())
    assert _counter((r.doc_id, r.size, r.text_crc32) for r in got) == want
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert set(slots) <= set(range(5))
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())


@pytest.mark.parametrize("hot", [False, True])
def test_shards_have_near_equal_bytes_also_when_all_rows_tie(spark, hot):
    docs = spark.range(6000).select(
        (F.lit(3) if hot else F.col("id")).alias("doc_id"), F.repeat(F.lit("ab "), (F.col("id") % 40 + 5).cast("int")).alias("text"),
        F.when((F.col("id") % 3 > 0) | F.lit(hot), F.lit("hot")).otherwise(F.col("id").cast("string")).alias("source"),
        F.lit(None).cast("string").alias("lang"), (F.lit(None).cast("long") if hot else F.col("id") % 40).alias("n_chars"))
    sizes = [r.bytes for r in kd_shards.shard_rows(docs, shards=16).groupBy("shard").agg(F.sum("size").alias("bytes")).collect()]
    assert len(sizes) == 16 and max(sizes) - min(sizes) < 0.05 * np.mean(sizes)


def test_target_bytes_set_the_number_of_shards(spark):
    docs = edge_docs(spark)
    total = sum(len((t or "").encode()) + 1 for _, t, *_ in rows())
    assert kd_shards.shard_rows(docs, target_bytes=total // 3 + 1).select("shard").distinct().count() <= 3
    assert kd_shards.shard_rows(empty_docs(spark), shards=4).count() == 0


def test_split_buckets_doubles_only_where_overfull():
    counts = np.zeros(16, dtype=np.int64)
    counts[3], counts[12] = 9, 1
    assert exact_dedup.split_buckets(counts, 10) == [(0, 0)]
    buckets = exact_dedup.split_buckets(counts, 5)
    assert (3, 4) in buckets and (1, 1) in buckets  # the full one as deep as it goes, the other half unsplit
    assert sum(2 ** (4 - d) for _, d in buckets) == 16


@pytest.mark.parametrize("capacity", [4096, 2])
def test_exact_dedup_against_a_dictionary(spark, capacity):
    got = exact_dedup.exact_dedup(edge_docs(spark), capacity).collect()
    groups = defaultdict(list)
    for d, t, *_ in rows():
        groups[t or ""].append(d)
    assert len(got) == len(rows())
    kept = Counter()
    for r in got:
        text = next(t for t in groups if hashlib.sha256(t.encode()).hexdigest() == r.text_sha256)
        assert r.group_size == len(groups[text])
        assert r.keep_id == max((d for d in groups[text] if d is not None), default=None)
        kept[text] += r.kept
        assert not r.kept or r.doc_id == r.keep_id
    assert set(kept.values()) == {1}


def test_dropping_duplicates_keeps_columns_and_one_row_per_text(spark):
    docs = edge_docs(spark)
    got = exact_dedup.drop_exact_duplicates(docs)
    assert got.columns == docs.columns
    texts = [r.text or "" for r in got.collect()]
    assert sorted(texts) == sorted({t or "" for _, t, *_ in rows()})
    assert exact_dedup.exact_dedup(empty_docs(spark)).count() == 0
    assert exact_dedup.drop_exact_duplicates(empty_docs(spark)).count() == 0


def _targets(sizes: dict, weights=(3, 1, 2)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
    weight = {s: weights[i % 3] for i, s in enumerate(order)}
    target, left, free = {}, 1.5 * sum(sizes.values()), set(order)
    while free:
        level = left / sum(weight[s] for s in free)
        over = {s for s in free if level * weight[s] > 2 * sizes[s]}
        if not over:
            return target | {s: level * weight[s] for s in free}
        for s in over:
            target[s] = 2.0 * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.mark.parametrize("range_rows", [20_000, 3])
def test_mixture_meets_its_targets(spark, range_rows):
    got = mixing.mixture(edge_docs(spark).select("doc_id", "text", "source"), range_rows=range_rows)
    found = got.collect()
    count = lambda t: len(WORD.findall(t or ""))
    sizes = Counter()
    for _, t, _, s, *_ in rows():
        sizes[s] += count(t)
    targets = _targets(sizes)
    assert _counter((r.doc_id, r.size) for r in found) == Counter((d, count(t)) for d, t, *_ in rows())
    by_target = defaultdict(lambda: [0, 0])
    for r in found:
        assert r.taken in (0, r.size, 2 * r.size)
        key = (r.source_size, round(r.target, 6))
        by_target[key][0] += r.taken
        by_target[key][1] = max(by_target[key][1], r.size)
    assert set(by_target) == {(sizes[s], round(targets[s], 6)) for s in sizes}
    for (size, target), (taken, largest) in by_target.items():
        same = sum((sizes[s], round(targets[s], 6)) == (size, target) for s in sizes)
        assert abs(taken - same * target) <= same * largest
    again = mixing.mixture(edge_docs(spark).repartition(7).select("doc_id", "text", "source"), range_rows=range_rows)
    assert _counter(again.collect()) == _counter(found)


def test_hot_source_is_cut_close_to_its_target(spark):
    docs = spark.createDataFrame([(i, prose(i, 5 + i % 9), "hot" if i % 3 else f"s{i % 2}") for i in range(1500)], "doc_id long, text string, source string")
    got = mixing.mixture(docs, range_rows=100).groupBy("source_size", "target").agg(F.sum("taken").alias("taken"), F.count("doc_id").alias("n")).collect()
    assert sum(r.n for r in got) == 1500
    assert len(got) == 3 and all(abs(r.taken - r.target) <= 14 for r in got)


def test_mixed_documents_repeat_as_the_mixture_takes_them(spark):
    docs = edge_docs(spark).filter("doc_id is not null").dropDuplicates(["doc_id"])
    mixed = mixing.mix_documents(docs)
    assert mixed.columns == docs.columns
    times = Counter(r.doc_id for r in mixed.collect())
    for r in mixing.mixture(docs).collect():
        if r.size:
            assert times[r.doc_id] == r.taken // r.size
    assert mixing.mixture(empty_docs(spark)).count() == 0
    assert mixing.mix_documents(empty_docs(spark)).count() == 0


def test_budgets_end_inside_groups_of_equal_rows(spark):
    """A third of all rows is one row without an id: its source still comes within half a document of its target."""
    docs = [(None, "the same five word text", "hot")] * 1000 + [(None, "the same five word text", None)] * 30
    docs += [(i, prose(i, 3 + i % 20), ("hot", None, "b", "c")[i % 4]) for i in range(400)] + [(500, " ", "hot")] * 20
    df = spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(7)
    for range_rows in (20_000, 50):
        rows_of = mixing.mixture(df, range_rows=range_rows).collect()
        assert len(rows_of) == len(docs) and all(r.taken in (0, r.size, 2 * r.size) for r in rows_of)
        sums = Counter()
        for r in rows_of:
            sums[r.source_size, r.target] += r.taken
        assert len(sums) == 4 and all(abs(taken - target) <= 11.5 for (_, target), taken in sums.items())
        again = mixing.mixture(df.repartition(3), range_rows=range_rows).collect()
        assert _counter(again) == _counter(rows_of)
    times = Counter((r.doc_id, r.text, r.source) for r in mixing.mix_documents(df).collect())
    words = Counter()
    for (_, text, source), n in times.items():
        words[source] += n * len(WORD.findall(text))
    assert sorted(words.values()) == sorted(sums.values())
