"""Metric scrapes: target discovery from annotations (P18/P19), outcome
classification (P22) and the one-record-per-target joins (J6/J6b).

The HTTP fetch itself is not rebuilt: a ``scrapes`` table holds what
each fetch returned (status, body, error kind/message).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsspark.functions.text import ws_trim
from obsspark.operators.checks import assert_at_most
from obsspark.params import MAX_METRICS_BODY_BYTES, METRICS_TIMEOUT_MS

# Scrape annotations, default path and outcome texts.
ANN_SCRAPE = "prometheus.io/scrape"
ANN_PORT = "prometheus.io/port"
ANN_PATH = "prometheus.io/path"
DEFAULT_METRICS_PATH = "/metrics"
REASON_ANNOTATION_MISSING = "annotation_missing"
REASON_NO_METRICS_URL = "no_metrics_url"
ERROR_PODIP_MISSING = "podIP_missing"
ERROR_FETCH_FAILED = "fetch_failed"
ERROR_TIMEOUT_FORMAT = "timeout after {timeout_ms}ms"
ERROR_TOO_LARGE_PREFIX, ERROR_TOO_LARGE_SUFFIX = "response_too_large (", " bytes)"
ERROR_STATUS_PREFIX, ERROR_STATUS_SUFFIX = "non-200 (", ")"


def scrape_port(port: Column) -> Column:
    """Leading integer of the port text (sign allowed, leading blanks
    skipped, trailing junk ignored); NULL when there is none."""
    digits = F.regexp_extract(port, r"^\s*([+-]?[0-9]+)", 1)
    return F.when(port.isNotNull() & (port != "") & (digits != ""), digits.try_cast("bigint"))


def scrape_path(path: Column) -> Column:
    p = ws_trim(path)
    ok = (p.isNotNull() & (p != "") & p.startswith("/") & ~p.contains("..") & ~p.contains("?")
          & ~p.contains("#"))
    return F.when(ok, p).otherwise(F.lit(DEFAULT_METRICS_PATH))


def scrape_targets(refs: DataFrame) -> DataFrame:
    """P18 + P19: add ``metrics_enabled``, ``port``, ``path`` and ``url``.

    Enabled iff the scrape annotation is exactly ``true`` and the port
    annotation has a positive leading integer; an invalid path falls
    back to ``/metrics``.
    """
    ann = F.col("annotations")
    port = scrape_port(F.element_at(ann, F.lit(ANN_PORT)))
    enabled = (F.coalesce(F.element_at(ann, F.lit(ANN_SCRAPE)) == F.lit("true"), F.lit(False))
               & F.coalesce(port > 0, F.lit(False)))
    out = refs.withColumns({
        "metrics_enabled": enabled,
        "port": F.when(enabled, port),
        "path": F.when(enabled, scrape_path(F.element_at(ann, F.lit(ANN_PATH)))),
    })
    return out.withColumn("url", F.when(enabled & F.coalesce(F.col("pod_ip") != "", F.lit(False)),
                                        F.concat(F.lit("http://"), F.col("pod_ip"), F.lit(":"),
                                                 F.col("port").cast("string"), F.col("path"))))


def assert_metrics_cap(targets: DataFrame, max_metrics_pods: int) -> None:
    """Too many annotated pods fails before any record."""
    assert_at_most(targets.filter("metrics_enabled"), max_metrics_pods,
                   f"maxMetricsPods exceeded (> {max_metrics_pods})")


def _outcome(max_body_bytes: int, timeout_ms: int, fetch_failed: Column) -> tuple[Column, Column]:
    """(ok, error) of an attempted fetch, in the reference's precedence:
    transport error, then body size, then HTTP status."""
    size = F.octet_length(F.col("body"))
    status = F.col("http_status")
    error = (F.when(F.col("error_kind") == "timeout", F.lit(ERROR_TIMEOUT_FORMAT.format(timeout_ms=timeout_ms)))
             .when(F.col("error_kind").isNotNull() | status.isNull(), fetch_failed)
             .when(F.coalesce(size, F.lit(0)) > max_body_bytes,
                   F.concat(F.lit(ERROR_TOO_LARGE_PREFIX), size.cast("string"), F.lit(ERROR_TOO_LARGE_SUFFIX)))
             .when(~status.between(200, 299),
                   F.concat(F.lit(ERROR_STATUS_PREFIX), status.cast("string"), F.lit(ERROR_STATUS_SUFFIX))))
    return error.isNull(), error


def classify_pod_scrapes(targets: DataFrame, scrapes: DataFrame,
                         max_body_bytes: int = MAX_METRICS_BODY_BYTES,
                         timeout_ms: int = METRICS_TIMEOUT_MS) -> DataFrame:
    """P22 + J6: exactly one ``metrics_text`` outcome per pod.

    ``targets`` from ``scrape_targets``; ``scrapes`` keyed (namespace,
    pod).  Columns: namespace, pod, pod_ip, port, path, skipped, reason,
    ok, error, content (pod_ip/port/path only once a URL exists).
    """
    s = scrapes.select(F.col("namespace").alias("_s_ns"), F.col("pod").alias("_s_pod"),
                       "http_status", "body", "error_kind", "error_message")
    j = targets.join(s, (F.col("namespace") == F.col("_s_ns")) & (F.col("name") == F.col("_s_pod")), "left")
    ok, error = _outcome(max_body_bytes, timeout_ms, F.lit(ERROR_FETCH_FAILED))
    en = F.col("metrics_enabled")
    has_ip = F.coalesce(F.col("pod_ip") != "", F.lit(False))
    fetched = en & has_ip
    return j.select(
        "namespace", F.col("name").alias("pod"),
        *[c for c in ("pod_ord",) if c in targets.columns],
        F.when(fetched, F.col("pod_ip")).alias("pod_ip"),
        F.when(fetched, F.col("port")).alias("port"),
        F.when(fetched, F.col("path")).alias("path"),
        F.when(~en, F.lit(True)).alias("skipped"),
        F.when(~en, F.lit(REASON_ANNOTATION_MISSING)).alias("reason"),
        F.when(en & ~has_ip, F.lit(False)).when(fetched, ok).alias("ok"),
        F.when(en & ~has_ip, F.lit(ERROR_PODIP_MISSING)).when(fetched, error).alias("error"),
        F.when(fetched & ok, F.coalesce(F.col("body"), F.lit(""))).alias("content"),
    )


def classify_service_scrapes(services: DataFrame, scrapes: DataFrame,
                             max_body_bytes: int = MAX_METRICS_BODY_BYTES,
                             timeout_ms: int = METRICS_TIMEOUT_MS) -> DataFrame:
    """P22 + J6b: exactly one outcome per selected service.

    ``scrapes`` keyed by ``service``.  A service without a metrics URL is
    skipped (``no_metrics_url``); transport failures read
    ``fetch_failed: <message>``.
    """
    s = scrapes.select(F.col("service").alias("_s_svc"), "http_status", "body", "error_kind", "error_message")
    j = services.join(s, F.col("name") == F.col("_s_svc"), "left")
    ff = F.concat(F.lit(ERROR_FETCH_FAILED + ": "), F.coalesce(F.col("error_message"), F.lit("unknown")))
    ok, error = _outcome(max_body_bytes, timeout_ms, ff)
    has_url = F.col("metrics").isNotNull()
    return j.select(
        F.col("service_idx"), F.col("name").alias("service"),
        F.col("metrics").alias("url"),
        F.when(~has_url, F.lit(True)).alias("skipped"),
        F.when(~has_url, F.lit(REASON_NO_METRICS_URL)).alias("reason"),
        F.when(has_url, ok).alias("ok"),
        F.when(has_url, error).alias("error"),
        F.when(has_url & ok, F.coalesce(F.col("body"), F.lit(""))).alias("content"),
    )
