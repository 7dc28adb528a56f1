"""Global ranking (K1/K2) and per-source / overall summaries."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsspark.session import ensure_session_defaults

# Results of this many tasks are merged by one task of the next level.
FAN_IN = 64


def merge_levels(spark: SparkSession, fan_in: int = FAN_IN, input_tasks: int | None = None) -> int:
    """Levels between the input tasks and the last merge, so that no task merges more than ``fan_in`` results.

    Without ``input_tasks`` four times ``spark.sql.shuffle.partitions`` are
    assumed, which ``scale_settings`` derives from the input's size.
    """
    tasks = input_tasks or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    levels = 0
    while tasks > fan_in:
        tasks = -(-tasks // fan_in)
        levels += 1
    return levels


def limit_in_tree(df: DataFrame, keys: Sequence[str], order: Sequence[Column], n: int,
                  fan_in: int = FAN_IN, levels: int | None = None) -> DataFrame:
    """The first ``n`` rows by ``order`` of every key within groups of input tasks, level by level.

    Each input task keeps n rows of a key before anything is shuffled (partial
    WindowGroupLimit); a task of the next level merges the rows of ``fan_in``
    tasks and keeps n again.  What is left holds the first n rows of every key:
    at most fan_in x n rows of a key, whatever the number of input tasks.
    """
    ensure_session_defaults(df.sparkSession, n)
    levels = merge_levels(df.sparkSession, fan_in) if levels is None else levels
    if not levels:
        return df
    df = df.withColumn("_task", F.spark_partition_id())
    for _ in range(levels):
        df = df.withColumn("_task", F.expr(f"cast(_task div {int(fan_in)} as int)"))
        in_group = F.row_number().over(Window.partitionBy(*keys, "_task").orderBy(*order))
        df = df.withColumn("_place", in_group).filter(F.col("_place") <= n).drop("_place")
    return df.drop("_task")


def rank_order(rank_col: str, tiebreak: Sequence[str]) -> list[Column]:
    """Newest first: rank time, NULL lowest, then arrival."""
    return [F.col(rank_col).desc_nulls_last()] + [F.col(c).desc() for c in tiebreak]


def newest_lines(df: DataFrame, k: int, rank_col: str = "rank_ms", tiebreak: Sequence[str] = (),
                 fan_in: int = FAN_IN, levels: int | None = None) -> DataFrame:
    """K1: the K highest lines by (rank time, NULL lowest, then arrival).

    ``tiebreak`` lists the arrival-order columns (source order, then line
    order).  A tree: input tasks keep K lines each, tasks of every level merge
    ``fan_in`` such results, and so does the last merge: none reads more than
    fan_in x K lines, however many input tasks there are.
    """
    if k <= 0:
        return df.filter(F.lit(False))
    order = rank_order(rank_col, tiebreak)
    return limit_in_tree(df, [], order, k, fan_in, levels).orderBy(*order).limit(k)


def final_order(df: DataFrame, rank_col: str = "rank_ms", tiebreak: Sequence[str] = (),
                position: str | None = None) -> DataFrame:
    """K2: selected lines ascending (NULL rank first, then arrival).

    ``position`` names a column for the place from 1 on; ``df`` is a top-K, so
    at most K rows are numbered in one task."""
    order = [F.col(rank_col).asc_nulls_first(), *[F.col(c).asc() for c in tiebreak]]
    if position is not None:
        df = df.withColumn(position, F.row_number().over(Window.orderBy(*order)))
    return df.orderBy(*order)


def source_summary(sources: DataFrame, counts: DataFrame, selected: DataFrame, keys: Sequence[str],
                   diagnostics: DataFrame | None = None) -> DataFrame:
    """G1: per source raw / matched / returned counts; sources without
    lines keep zero counts; skip reason and error of failed sources.

    ``counts``: keys, raw_log_records, matched_log_records of the sources with lines."""
    keys = list(keys)
    returned = selected.groupBy(*keys).agg(F.count(F.lit(1)).alias("returned_log_records"))
    out = (sources.join(counts, keys, "left").join(returned, keys, "left")
           .withColumns({c: F.coalesce(F.col(c), F.lit(0)).cast("long") for c in
                         ("raw_log_records", "matched_log_records", "returned_log_records")}))
    if diagnostics is not None:
        d = diagnostics.select(*keys, F.lit(True).alias("skipped"), "reason", "error")
        out = out.join(d, keys, "left")
    return out


def log_summary(summary: DataFrame, diagnostics: DataFrame, max_total_log_lines: int) -> DataFrame:
    """One row of totals; no row when there is no source at all.

    Per-source counts and diagnostic records are stacked and summed in
    one global aggregate (partial sums per partition, one tiny merge).
    """
    z = F.lit(0).cast("long")
    stacked = (summary.select(F.col("matched_log_records").cast("long").alias("m"),
                              F.col("returned_log_records").cast("long").alias("r"),
                              F.lit(1).cast("long").alias("s"), z.alias("d"))
               .unionByName(diagnostics.select(z.alias("m"), z.alias("r"), z.alias("s"),
                                               F.lit(1).cast("long").alias("d"))))
    tot = stacked.agg(*[F.coalesce(F.sum(c), z).alias(c) for c in ("m", "r", "s", "d")])
    return (tot.filter(F.col("s") > 0)
            .select(F.lit(max_total_log_lines).cast("long").alias("max_total_log_lines"),
                    (F.col("m") > F.col("r")).alias("line_limited"),
                    F.col("m").alias("matched_log_records"),
                    F.col("r").alias("returned_log_records"),
                    F.col("d").alias("diagnostic_records"),
                    F.col("s").alias("n_sources")))
