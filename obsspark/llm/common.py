"""Helpers shared by the operators: shared storage, bounded filters, small joins."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from obsspark.session import ship_package

#: bits of a membership filter; its broadcast table has at most bits / 64 rows
FILTER_BITS = 1 << 22
#: rows up to which a counted table may be broadcast
BROADCAST_ROWS = 50_000
#: words are runs of characters outside ASCII white space
WORD = r"[^\x20\x09-\x0D]+"


def map_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]],
              schema: str | StructType) -> DataFrame:
    """``mapInArrow`` with a function of this package."""
    ship_package(df.sparkSession)
    return df.mapInArrow(run, schema)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that the cluster names in ``spark.checkpoint.dir``.

    Without that setting, a local session uses a folder of its warehouse; any
    other master raises, since executors would not share a folder of our choice.
    """
    base = spark.sparkContext.getConf().get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        master = spark.sparkContext.master
        if not (master == "local" or master.startswith("local[")):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_checkpoints"
    return base.rstrip("/")


_scratch: list[list[str]] = []


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Remove, in the end, what ``stored`` has written inside, but for what it was told to keep.

    For code that keeps a table which no longer depends on the others.
    """
    _scratch.append([])
    try:
        yield
    finally:
        conf = spark.sparkContext._jsc.hadoopConfiguration()
        for name in _scratch.pop():
            path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(conf).delete(path, True)


def stored(df: DataFrame, name: str, keep: bool = False) -> DataFrame:
    """Write ``df`` to a new folder of the shared storage and read it from there.

    Cuts lineage: a lost executor costs the tasks that ran on it, not the stages
    before the write, and values such as row ids stay what they were.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/obsspark-{name}-{uuid.uuid4().hex}"
    if _scratch and not keep:
        _scratch[-1].append(path)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def utf8(text: Column) -> Column:
    """The text, null as empty."""
    return F.coalesce(text, F.lit(""))


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)).cast("long"), F.lit(0).cast("long"))


def small_join(df: DataFrame, table: DataFrame, on: Column, how: str, rows: int) -> DataFrame:
    """Join with a table of ``rows`` counted rows: broadcast while few, else shuffled."""
    return df.join(F.broadcast(table) if rows <= BROADCAST_ROWS else table, on, how)


def _slot(key: Column, bits: int) -> Column:
    return F.shiftrightunsigned(F.xxhash64(key), 1) % F.lit(bits)


def membership_filter(keys: DataFrame, key: str, bits: int = FILTER_BITS) -> DataFrame:
    """A bit map of the keys' hashes: at most bits / 64 rows (word, mask), whatever the number of keys."""
    slot = _slot(F.col(key), bits)
    return (keys.select(slot.alias("_slot"))
            .groupBy(F.shiftright("_slot", 6).alias("_word"))
            .agg(F.bit_or(F.expr("shiftleft(1L, cast(_slot & 63 as int))")).alias("_mask")))


def maybe_in(df: DataFrame, key: Column, bit_map: DataFrame, bits: int = FILTER_BITS, flag: str = "_maybe") -> DataFrame:
    """Add ``flag``: false only if the key is surely not among the filter's keys.

    The map is broadcast: its size is bounded by ``bits``.  More keys than bits
    only make the filter useless, never wrong.
    """
    slot = _slot(key, bits)
    out = df.withColumn("_probe", slot).join(F.broadcast(bit_map), F.shiftright("_probe", 6) == F.col("_word"), "left")
    hit = F.coalesce(F.expr("(shiftrightunsigned(_mask, cast(_probe & 63 as int)) & 1) = 1"), F.lit(False))
    return out.withColumn(flag, hit).drop("_probe", "_word", "_mask")
