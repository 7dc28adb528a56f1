"""Tails by trees and inheritance over chunks agree with the plain window."""

import random

from pyspark.sql import Window
from pyspark.sql import functions as F

from obsspark.operators.lines import inherit_last, tail_per_source


def _data(spark, seed, n=600):
    rnd = random.Random(seed)
    rows = []
    for i in range(n):
        src = rnd.choice(["a", "b", "c"]) if rnd.random() < 0.8 else "hot"
        v = rnd.randint(0, 1000) if rnd.random() < 0.3 else None
        rows.append((src, i, v))
    return spark.createDataFrame(rows, "src string, seq long, v long")


def test_inherit_last_matches_plain_window(spark):
    for seed in range(3):
        df = _data(spark, seed)
        plain = df.withColumn("want", F.last("v", ignorenulls=True).over(
            Window.partitionBy("src").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)))
        for chunk_rows in (1, 7, 50, 10_000):
            got = inherit_last(plain, ["src"], "seq", "v", "got", chunk_rows=chunk_rows)
            bad = got.filter(~F.col("want").eqNullSafe(F.col("got"))).count()
            assert bad == 0, (seed, chunk_rows)


def test_tail_tree_matches_plain(spark):
    for seed in range(3):
        df = _data(spark, seed).repartition(7)
        for n in (1, 5, 60, 1000):
            last = F.row_number().over(Window.partitionBy("src").orderBy(F.desc("seq")))
            plain = df.withColumn("r", last.cast("long")).filter(F.col("r") <= n)
            for levels in (0, 1, 3):
                tree = tail_per_source(df, ["src"], "seq", n, rank_col="r", fan_in=2, levels=levels)
                assert sorted(map(tuple, plain.collect())) == sorted(map(tuple, tree.collect())), (seed, n, levels)


def test_tail_and_inheritance_scan_their_input_once(spark, tmp_path):
    _data(spark, 1).write.parquet(str(tmp_path / "lines"))
    df = spark.read.parquet(str(tmp_path / "lines"))
    tail = tail_per_source(df, ["src"], "seq", 5, levels=2)._jdf.queryExecution().executedPlan().toString()
    assert tail.count("FileScan parquet") == 1
    # what inheritance does after its one pass reads what that has written
    after = inherit_last(df, ["src"], "seq", "v", "got")._jdf.queryExecution().executedPlan().toString()
    assert "FileScan parquet" not in after


def test_null_keys_and_orders_are_kept(spark):
    rows = [(None, 1, 1), (None, 2, 2), (None, None, 3), ("a", None, 4), ("a", 60_000, 5), (None, 120_000, 6)]
    df = spark.createDataFrame(rows, "src string, seq long, v long")
    got = lambda n: sorted(r.v for r in tail_per_source(df, ["src"], "seq", n).collect())
    assert got(9) == [1, 2, 3, 4, 5, 6] and got(1) == [5, 6] and got(3) == [1, 2, 4, 5, 6]
    assert inherit_last(df, ["src"], "seq", "v", "w").count() == 6


def test_explicit_chunk_column_and_multi_order(spark):
    rows = [("f", blk, row, v) for blk in (0, 100, 200) for row, v in enumerate([None, blk + 1, None])]
    df = spark.createDataFrame(rows, "src string, blk long, row long, v long")
    got = inherit_last(df, ["src"], ["blk", "row"], "v", "got", chunk_col="blk")
    res = {(r.blk, r.row): r.got for r in got.collect()}
    assert res == {(0, 0): None, (0, 1): 1, (0, 2): 1, (100, 0): 1, (100, 1): 101, (100, 2): 101,
                   (200, 0): 101, (200, 1): 201, (200, 2): 201}
