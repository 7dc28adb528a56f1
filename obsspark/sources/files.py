"""Log files as a line table; J4: which expected paths cannot be read."""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsspark.session import keep
from obsspark.sources.ranges import SPLIT_BYTES, TAIL_BYTES, file_ranges, list_files, read_ranges, tail_ranges

#: rows after which a task counts on to the next block
BLOCK_ROWS = 50_000


def read_log_files(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Physical lines of text files: (file, block, row, raw).

    Lines split on ``\\n`` only (``\\r`` stays in the line; Spark's
    default text reader would also split on ``\\r``).  ``block`` is the
    byte offset of the file split a line came from and ``row`` the
    line's position inside its task, so ``(block, row)`` is the
    physical order inside a file and ``block`` is the natural chunk for
    the two-phase window operators.  A split counts one block further after
    every BLOCK_ROWS rows of its task, so that a gzip file, which Spark does
    not split, is no single chunk; a line takes a byte at least, so blocks
    never reach the next split's offset.
    """
    df = spark.read.option("lineSep", "\n").option("wholetext", "false").text(list(paths))
    return df.select(
        F.col("_metadata.file_path").alias("file"),
        (F.col("_metadata.file_block_start") + F.expr(f"(monotonically_increasing_id() & {(1 << 33) - 1}) div {BLOCK_ROWS}"))
        .alias("block"),
        F.monotonically_increasing_id().alias("row"),
        F.col("value").alias("raw"))


def file_source_lines(spark: SparkSession, sources: DataFrame, keys: Sequence[str] = ("service", "source"),
                      path_col: str = "file", tail_lines: int | None = None,
                      split_bytes: int | None = None) -> tuple[DataFrame, DataFrame]:
    """S1 for registry file sources: (lines, errors).

    ``lines``: keys + block + row + raw of every configured file that can be
    read, the last ``tail_lines`` lines where given (read from the files'
    ends); a file shared by several sources feeds each, once per value of
    ``keys`` however often a source lists it.  ``errors``: keys + code, stderr,
    message of configured files that cannot be read (J4: ENOENT, EACCES, ...).
    Paths stay a table: they are looked up and opened by tasks, never
    collected.  Use ``order_col=["block", "row"]`` and ``chunk_col="block"``
    with ``collect_service_logs``.
    """
    keys = list(keys)
    wanted = sources.filter(F.col(path_col).isNotNull()).select(*keys, F.col(path_col).alias("_path")).distinct()
    files = keep(list_files(wanted, "_path"))
    if tail_lines is not None:
        ranges = tail_ranges(files, tail_lines, split_bytes or TAIL_BYTES)
    else:
        ranges = file_ranges(files, split_bytes or SPLIT_BYTES).withColumn("skip", F.lit(0).cast("long"))
    own = [f"_key{i}" for i in range(len(keys))]
    owners = wanted.select(*[F.col(k).alias(o) for k, o in zip(keys, own, strict=True)], F.col("_path"))
    lines = read_ranges(ranges.join(owners, F.col("path") == F.col("_path")).select("path", "start", "end", "skip", *own), own)
    failed = files.filter("code is not null").join(wanted, F.col("path") == F.col("_path"))
    return (lines.withColumnsRenamed(dict(zip(own, keys, strict=True))),
            failed.select(*keys, "code", F.lit("").alias("stderr"), "message"))


def write_source_files(lines: DataFrame, path: str, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """Lines (keys, order, raw) as one text file per source under ``path``; returns (keys, path) of the files.

    For exports and for queries that read files back."""
    spark = lines.sparkSession
    (lines.select(*keys, *order, "raw").repartition(*keys).sortWithinPartitions(*keys, *order).select(*keys, "raw")
     .write.partitionBy(*keys).text(path))
    kinds = dict(lines.dtypes)
    # the contents column is not read, only the listing
    found = spark.read.format("binaryFile").option("pathGlobFilter", "*.txt").load(path)
    return found.select(*[F.col(k).cast(kinds[k]).alias(k) for k in keys], "path")
