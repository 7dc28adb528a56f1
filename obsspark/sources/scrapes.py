"""Scrape outcomes (what each metrics fetch returned)."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

SCRAPE = T.StructType([
    T.StructField("namespace", T.StringType()), T.StructField("pod", T.StringType()),
    T.StructField("service", T.StringType()), T.StructField("http_status", T.IntegerType()),
    T.StructField("body", T.StringType()), T.StructField("error_kind", T.StringType()),
    T.StructField("error_message", T.StringType()),
])


def read_scrapes(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Outcome rows keyed by (namespace, pod) or service; ``error_kind``
    is ``timeout`` for aborted fetches, anything else for transport
    failures; ``body`` stays opaque text."""
    reader = spark.read.format(fmt)
    if fmt != "parquet":
        reader = reader.schema(SCRAPE)
    return reader.load(path)
