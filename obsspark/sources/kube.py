"""Kubernetes objects as tables.

The reference asks the API server; here the same JSON documents (pod
lists, event lists, container log text) are files or tables.
Explicit schemas: nothing is inferred, absent fields read as NULL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsspark.sources.json_ranges import SPLIT_BYTES, json_elements, json_files

NAMED = T.ArrayType(T.StructType([T.StructField("name", T.StringType())]))
STR_MAP = T.MapType(T.StringType(), T.StringType())

POD = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("namespace", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("uid", T.StringType()), T.StructField("labels", STR_MAP),
        T.StructField("annotations", STR_MAP)])),
    T.StructField("spec", T.StructType([
        T.StructField("containers", NAMED), T.StructField("initContainers", NAMED),
        T.StructField("nodeName", T.StringType())])),
    T.StructField("status", T.StructType([
        T.StructField("podIP", T.StringType()), T.StructField("phase", T.StringType()),
        T.StructField("conditions", T.ArrayType(T.StructType([
            T.StructField("type", T.StringType()), T.StructField("status", T.StringType())])))])),
])

EVENT = T.StructType([
    T.StructField("metadata", T.StructType([
        T.StructField("creationTimestamp", T.StringType()), T.StructField("namespace", T.StringType())])),
    T.StructField("lastTimestamp", T.StringType()), T.StructField("eventTime", T.StringType()),
    T.StructField("reason", T.StringType()), T.StructField("message", T.StringType()),
    T.StructField("involvedObject", T.StructType([
        T.StructField("kind", T.StringType()), T.StructField("name", T.StringType()),
        T.StructField("namespace", T.StringType()), T.StructField("uid", T.StringType())])),
])


def _listed(spark: SparkSession, paths, schema: T.StructType, split_bytes: int) -> DataFrame:
    """(page, item, e): the items of list documents, large ones read by several tasks."""
    found = json_elements(json_files(spark, paths), "items", split_bytes)
    return found.select(F.col("path").alias("page"), "item", F.from_json("value", schema, {"mode": "FAILFAST"}).alias("e"))


def read_pods(spark: SparkSession, paths, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Pod list pages (one JSON document per file, any number of
    pages of any size) -> one row per pod, with ``page`` and ``item`` ordinals."""
    return _listed(spark, paths, POD, split_bytes).select("page", "item", "e.*")


def read_events(spark: SparkSession, paths, namespaces=None, split_bytes: int = SPLIT_BYTES) -> DataFrame:
    """Event list documents -> flat events (namespace = listing
    namespace, the three timestamp candidates, involved object).
    ``namespaces`` restricts to the selected namespaces."""
    ev = _listed(spark, paths, EVENT, split_bytes)
    out = ev.select(
        "page", "item",
        F.coalesce(F.col("e.metadata.namespace"), F.col("e.involvedObject.namespace")).alias("namespace"),
        F.col("e.lastTimestamp").alias("last_timestamp"), F.col("e.eventTime").alias("event_time"),
        F.col("e.metadata.creationTimestamp").alias("creation_timestamp"),
        F.col("e.reason").alias("reason"), F.col("e.message").alias("message"),
        F.col("e.involvedObject.kind").alias("obj_kind"), F.col("e.involvedObject.name").alias("obj_name"),
        F.col("e.involvedObject.uid").alias("obj_uid"),
        F.col("e.involvedObject.namespace").alias("obj_namespace"))
    if namespaces is not None:
        out = out.filter(F.col("namespace").isin(list(namespaces)))
    return out


def read_container_logs(logs: DataFrame, text_col: str = "text") -> DataFrame:
    """S3: container log blobs (namespace, pod, container, previous,
    text) -> one row per line with its position (split on '\\n')."""
    return logs.select("namespace", "pod", "container", "previous",
                       F.posexplode(F.split(F.col(text_col), "\n")).alias("pos", "raw"))
