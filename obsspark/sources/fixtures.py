"""Observability tables derived from the driver's parquet tables.

The driver ships TPC-H-ish tables plus an ``events`` stream.  These
builders reshape them into the tables the operators consume (log lines,
service registry, pods, Kubernetes events, container logs, scrape
outcomes, source errors, principals) with plain DataFrame projections,
so every query's work grows with the input tables.  The DuckDB oracle
builds the very same rows from the same parquet files
(``obsspark.plans.oracle``).
"""

from __future__ import annotations

import functools
import weakref

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsspark.functions.timeparse import ISO_MS_FORMAT

# DataFrames are immutable and lazy: one analysed plan per
# (session, directory, table) is reused instead of re-listing files and
# re-reading parquet footers for every query that touches the table.
_FRAMES: "weakref.WeakKeyDictionary[SparkSession, dict]" = weakref.WeakKeyDictionary()


def _memo(fn):
    @functools.wraps(fn)
    def wrapper(spark: SparkSession, sf_dir: str, *args):
        cache = _FRAMES.setdefault(spark, {})
        key = (fn.__name__, sf_dir.rstrip("/"), args)
        if key not in cache:
            cache[key] = fn(spark, sf_dir, *args)
        return cache[key]
    return wrapper


@_memo
def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def _s(c) -> F.Column:
    return (F.col(c) if isinstance(c, str) else c).cast("string")


def _iso(c) -> F.Column:
    return F.date_format(F.col(c), ISO_MS_FORMAT)


@_memo
def log_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """8 services x 5 files; ``seq`` is arrival order within a source.

    Columns: service, file, is_journal, seq, raw, entry_ts (the event's
    own time: the journal entry time a journal would select by).
    """
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    raw = (F.when(eid % 50 == 7, F.lit(""))
           .when(eid % 200 == 11, F.lit("   "))
           .when(eid % 200 == 9, F.lit("-- No entries --"))
           .when(eid % 10 == 3, F.concat(F.upper("event_type"), F.lit(" user="), _s("user_id")))
           .when(eid % 97 == 0, F.concat(F.lit("2024-02-30T00:00:00Z "), F.col("event_type")))
           .otherwise(F.concat(_iso("ts"), F.lit(" "), F.col("event_type"), F.lit(" user="),
                               _s("user_id"), F.lit(" "), F.col("props"))))
    return e.select(
        F.concat(F.lit("svc-"), _s(F.col("user_id") % 8)).alias("service"),
        F.concat(F.lit("/var/log/"), F.col("event_type"), F.lit(".log")).alias("file"),
        F.col("event_type").isin("error", "view").alias("is_journal"),
        eid.alias("seq"),
        raw.alias("raw"),
        F.col("ts").alias("entry_ts"),
    )


@_memo
def services(spark: SparkSession, sf_dir: str) -> DataFrame:
    """service registry, one row per service."""
    e = table(spark, sf_dir, "events")
    k = F.col("user_id") % 8
    return e.select(
        k.cast("int").alias("service_idx"),
        F.concat(F.lit("svc-"), _s(k)).alias("name"),
        F.when(k.isin(1, 3, 5), F.concat(F.lit("unit-"), _s(k), F.lit(".service"))).alias("journal"),
        F.when(k == 5, F.lit("user")).when(k.isin(1, 3), F.lit("system")).alias("journal_scope"),
        F.when(k != 2, F.concat(F.lit("http://10.0.0."), _s(k), F.lit(":9090/metrics"))).alias("metrics"),
    ).distinct()


@_memo
def pods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one row per pod, labels/annotations as scalar columns."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    return c.select(
        F.concat(F.lit("ns-"), _s(k % 5)).alias("namespace"),
        F.concat(F.lit("pod-"), _s(k)).alias("name"),
        F.when(k % 7 == 0, F.lit(None).cast("string")).otherwise(F.concat(F.lit("uid-"), _s(k))).alias("uid"),
        F.lower("c_mktsegment").alias("label_app"),
        F.when(k % 2 == 0, F.lit("backend")).otherwise(F.lit("frontend")).alias("label_tier"),
        F.when(k % 4 == 0, F.lit(None).cast("string")).when(k % 9 == 8, F.lit("True"))
        .otherwise(F.lit("true")).alias("ann_scrape"),
        F.when(k % 6 == 0, F.lit(None).cast("string")).when(k % 6 == 1, F.lit("abc"))
        .when(k % 6 == 2, F.lit("-1")).when(k % 6 == 3, F.lit("9090abc"))
        .when(k % 6 == 4, F.lit(" 80")).otherwise(F.lit("8080")).alias("ann_port"),
        F.when(k % 5 == 0, F.lit(None).cast("string")).when(k % 5 == 1, F.lit("/custom"))
        .when(k % 5 == 2, F.lit("nope")).when(k % 5 == 3, F.lit("/a/../b"))
        .otherwise(F.lit(" /m?x=1")).alias("ann_path"),
        F.when(k % 13 == 0, F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("10.0.0."), _s(k % 250))).alias("pod_ip"),
        F.lit("main").alias("container"),
        F.when(k % 3 == 0, F.lit("init")).alias("init_container"),
        (F.col("c_acctbal") > 0).alias("ready"),
    )


@_memo
def kube_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kubernetes events derived from orders."""
    o = table(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    iso = _iso("o_orderdate")
    null_s = F.lit(None).cast("string")
    return o.select(
        k.alias("event_id"),
        F.concat(F.lit("ns-"), _s(F.col("o_custkey") % 5)).alias("namespace"),
        F.when(k % 4 == 0, null_s).otherwise(iso).alias("last_timestamp"),
        F.when(k % 8 == 0, null_s).otherwise(iso).alias("event_time"),
        F.when(k % 16 == 0, null_s).otherwise(iso).alias("creation_timestamp"),
        F.when(k % 6 == 0, F.lit("OOMKilled")).when(k % 6 == 1, F.lit("CrashLoopBackOff"))
        .when(k % 6 == 2, F.lit("FailedScheduling")).otherwise(F.lit("Started")).alias("reason"),
        F.col("o_orderpriority").alias("message"),
        F.when(k % 11 == 0, F.lit("Node")).otherwise(F.lit("Pod")).alias("obj_kind"),
        F.concat(F.lit("pod-"), _s("o_custkey")).alias("obj_name"),
        F.when(k % 3 == 0, null_s).when(k % 5 == 0, F.lit("uid-stale"))
        .otherwise(F.concat(F.lit("uid-"), _s("o_custkey"))).alias("obj_uid"),
    )


@_memo
def container_logs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """container log lines keyed (namespace, pod, container, previous)."""
    e = table(spark, sf_dir, "events")
    eid = F.col("event_id")
    return (e.select(
                F.concat(F.lit("ns-"), _s(F.col("user_id") % 5)).alias("namespace"),
                F.concat(F.lit("pod-"), _s("user_id")).alias("pod"),
                F.lit("main").alias("container"),
                ((eid % 5 == 0) & (F.col("user_id") % 2 == 0)).alias("previous"),
                eid.alias("pos"),
                F.when(eid % 10 == 3, F.concat(F.col("event_type"), F.lit(" no timestamp")))
                .otherwise(F.concat(_iso("ts"), F.lit(" "), F.col("event_type"), F.lit(" "), F.col("props")))
                .alias("raw")))


@_memo
def scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """one scrape outcome per pod whose fetch was attempted."""
    c = table(spark, sf_dir, "customer")
    k = F.col("c_custkey")
    m = k % 10
    return c.select(
        F.concat(F.lit("ns-"), _s(k % 5)).alias("namespace"),
        F.concat(F.lit("pod-"), _s(k)).alias("pod"),
        F.when(m == 0, F.lit(503)).when(m == 1, F.lit(404)).when(m.isin(2, 3), F.lit(None).cast("int"))
        .when(m == 4, F.lit(204)).otherwise(F.lit(200)).alias("http_status"),
        F.when(m == 2, F.lit("timeout")).when(m == 3, F.lit("connect")).alias("error_kind"),
        F.when(m == 3, F.lit("ECONNREFUSED")).alias("error_message"),
        F.when(m.isin(2, 3), F.lit(None).cast("string"))
        .otherwise(F.concat(F.lit("metric_a "), _s(k))).alias("body"),
    )


@_memo
def source_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """sources whose read failed."""
    e = table(spark, sf_dir, "events")
    et = F.col("event_type")
    return (e.filter((F.col("user_id") % 8).isin(2, 6) & et.isin("click", "view", "error"))
            .select(
                F.concat(F.lit("svc-"), _s(F.col("user_id") % 8)).alias("service"),
                F.concat(F.lit("/var/log/"), et, F.lit(".log")).alias("file"),
                F.when(et == "click", F.lit("ENOENT")).when(et == "view", F.lit("EACCES"))
                .otherwise(F.lit("EOTHER")).alias("code"),
                F.when(et == "error", F.lit("Permission denied")).otherwise(F.lit("")).alias("stderr"),
                F.lit("read failed").alias("message"))
            .distinct())


# The principals fixture (sub, admin, namespace glob, service glob).
PRINCIPAL_ROWS = [
    ("root", True, None, None),
    ("all", False, "ns-*", "svc-*"),
    ("narrow", False, "ns-1", "svc-*3"),
    ("mid", False, "*-2", "svc-1"),
    ("star", False, "*", "*"),
    ("none", False, "prod-*", "x*y"),
]

# Capabilities granted to each non-admin principal above.
PRINCIPAL_CAPABILITIES = [
    ("all", "pods"), ("all", "logs"), ("all", "events"), ("all", "metrics"),
    ("narrow", "logs"),
    ("mid", "events"), ("mid", "metrics"),
    ("star", "pods"), ("star", "logs"),
]


def principal_patterns(spark: SparkSession) -> DataFrame:
    """F8: one row per (principal, pattern)."""
    return spark.createDataFrame(
        PRINCIPAL_ROWS, "sub string, admin boolean, ns_pattern string, svc_pattern string")


def principal_capabilities(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(PRINCIPAL_CAPABILITIES, "sub string, capability string")


@_memo
def pod_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F3 shaped like the Kubernetes pod object (metadata / spec / status),
    the same schema ``read_pods`` yields from JSON pod lists."""
    p = pods(spark, sf_dir)

    def entries(*kv):
        return F.map_from_entries(F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value"))
                                                      for k, v in kv]),
                                           lambda e: e["value"].isNotNull()))

    return p.select(
        F.struct(
            F.col("namespace").alias("namespace"), F.col("name").alias("name"), F.col("uid").alias("uid"),
            entries(("app", F.col("label_app")), ("tier", F.col("label_tier"))).alias("labels"),
            entries(("prometheus.io/scrape", F.col("ann_scrape")), ("prometheus.io/port", F.col("ann_port")),
                    ("prometheus.io/path", F.col("ann_path"))).alias("annotations"),
        ).alias("metadata"),
        F.struct(
            F.array(F.struct(F.col("container").alias("name"))).alias("containers"),
            F.when(F.col("init_container").isNotNull(), F.array(F.struct(F.col("init_container").alias("name"))))
            .otherwise(F.array().cast("array<struct<name:string>>")).alias("initContainers"),
            F.concat(F.lit("node-"), F.col("namespace")).alias("nodeName"),
        ).alias("spec"),
        F.struct(
            F.col("pod_ip").alias("podIP"),
            F.when(F.col("ready"), F.lit("Running")).otherwise(F.lit("Pending")).alias("phase"),
            F.array(F.struct(F.lit("Ready").alias("type"),
                             F.when(F.col("ready"), F.lit("True")).otherwise(F.lit("False")).alias("status")))
            .alias("conditions"),
        ).alias("status"),
    )


@_memo
def registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F2 plus each service's log files (the F1 file sources of that
    service, sorted): the registry entry shape (name, logs[], journal,
    journal_scope, journal_user, metrics)."""
    files = (log_lines(spark, sf_dir).filter(~F.col("is_journal"))
             .groupBy(F.col("service").alias("name"))
             .agg(F.array_sort(F.collect_set("file")).alias("logs")))
    return (services(spark, sf_dir).join(files, "name", "left")
            .select("service_idx", "name", "logs", "journal", "journal_scope",
                    F.lit(None).cast("string").alias("journal_user"), "metrics"))


@_memo
def service_scrapes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F6 outcomes re-keyed for the registry: service ``svc-i`` was
    scraped through pod ``pod-i`` of namespace ``ns-(i % 5)``."""
    s = scrapes(spark, sf_dir)
    reg = services(spark, sf_dir).select("service_idx", "name")
    key_ns = F.concat(F.lit("ns-"), (F.col("service_idx") % 5).cast("string"))
    key_pod = F.concat(F.lit("pod-"), F.col("service_idx").cast("string"))
    return (reg.join(s, (s["namespace"] == key_ns) & (s["pod"] == key_pod), "inner")
            .select(F.col("name").alias("service"), "http_status", "body", "error_kind", "error_message"))
