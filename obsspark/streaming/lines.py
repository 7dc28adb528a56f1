"""Stateless line operators on a stream.

The reference reads finite inputs, but every per-line operator
(P1-P5, P9, P10) is a pure column expression, so the same functions run
unchanged on ``readStream``.  Window (W1/W2) and top-K (K1) operators
are batch-only and are not offered here.
"""

from __future__ import annotations

from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from obsspark.functions.text import exclude_any, include_any, is_journal_noise
from obsspark.functions.timeparse import parse_line_columns
from obsspark.operators.lines import in_window_lenient
from obsspark.session import shared_dir


def parsed_line_stream(spark: SparkSession, directory: str, include: Sequence[str] = (),
                       exclude: Sequence[str] = (), journal: bool = False,
                       start_ms: int | None = None, end_ms: int | None = None,
                       max_files_per_trigger: int | None = None) -> DataFrame:
    """New text files in ``directory`` as parsed, filtered lines:
    file, raw, ts, line, sort_ms.  Empty lines dropped (P9); journal
    noise (P10) and the lenient window (P5) only for ``journal``."""
    reader = spark.readStream.option("lineSep", "\n")
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", str(max_files_per_trigger))
    df = reader.text(directory).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("raw"))
    ts, line, ms = parse_line_columns(F.col("raw"))
    df = df.filter(F.length("raw") > 0).withColumns({"ts": ts, "line": line, "sort_ms": ms})
    if journal:
        df = df.filter(~is_journal_noise(F.col("raw")) & in_window_lenient(F.col("sort_ms"), start_ms, end_ms))
    return df.filter(include_any(F.col("raw"), include) & ~exclude_any(F.col("raw"), exclude))


def write_line_stream(df: DataFrame, path: str, checkpoint: str | None = None,
                      once: bool = True) -> StreamingQuery:
    """Append parsed lines as parquet; the checkpoint lives in the
    cluster's shared checkpoint folder unless given."""
    ckpt = checkpoint or shared_dir(df.sparkSession, "stream-ckpt")
    w = df.writeStream.format("parquet").option("path", path).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if once else w
    return w.start()
