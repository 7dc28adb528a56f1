"""Consumer-side analysis of a bundle (G8 error signatures, G9 anomaly
triage), as documented for the bundle's reader."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Triage priorities.
PRIORITY_EVENT_REASONS = ["OOMKilled", "CrashLoopBackOff", "FailedScheduling"]
PRIORITY_LOG_KEYWORDS = ["panic", "fatal", "segfault", "timeout", "connection refused"]

# Signature rule (ours): digit runs collapse to <n>.
SIGNATURE_DIGITS = "[0-9]+"
SIGNATURE_TOKEN = "<n>"


def error_signatures(lines: DataFrame, line_col: str = "line", time_col: str = "rank_ms",
                     needle: str = "error") -> DataFrame:
    """Recurring error lines grouped by signature with count, first
    and last occurrence.  A plain aggregate: partial counts per
    partition, so a hot signature is never gathered in one task."""
    sig = F.regexp_replace(F.col(line_col), SIGNATURE_DIGITS, SIGNATURE_TOKEN)
    return (lines.filter(F.lower(F.col(line_col)).contains(needle))
            .groupBy(sig.alias("signature"))
            .agg(F.count(F.lit(1)).alias("n"), F.min(time_col).alias("first_ms"),
                 F.max(time_col).alias("last_ms")))


def keyword_prefilter(log_lines: DataFrame, raw_col: str = "raw") -> DataFrame:
    """Keep raw lines that contain a triage keyword (case-insensitive);
    apply before parsing so most lines never reach the parser."""
    low = F.lower(F.col(raw_col))
    kw = F.lit(False)
    for k in PRIORITY_LOG_KEYWORDS:
        kw = kw | low.contains(k)
    return log_lines.filter(kw)


def anomaly_triage(events: DataFrame, log_lines: DataFrame, metrics: DataFrame) -> DataFrame:
    """(priority, target, n).  1 = alarming event reasons, 2 = log
    lines with failure keywords, 3 = failed scrapes (skipped is normal).

    ``events``: namespace, obj_name, reason.  ``log_lines``: namespace,
    pod, line.  ``metrics``: namespace, pod, ok.
    """
    target = lambda ns, name: F.concat(F.col(ns), F.lit("/"), F.col(name))

    def has_keyword(c: str):
        low = F.lower(F.col(c))
        kw = F.lit(False)
        for k in PRIORITY_LOG_KEYWORDS:
            kw = kw | low.contains(k)
        return kw

    kw = has_keyword("line")
    p1 = events.filter(F.col("reason").isin(PRIORITY_EVENT_REASONS)).select(
        F.lit(1).alias("priority"), target("namespace", "obj_name").alias("target"))
    p2 = log_lines.filter(kw).select(F.lit(2).alias("priority"), target("namespace", "pod").alias("target"))
    p3 = metrics.filter(F.col("ok") == F.lit(False)).select(
        F.lit(3).alias("priority"), target("namespace", "pod").alias("target"))
    return (p1.unionByName(p2).unionByName(p3)
            .groupBy("priority", "target").agg(F.count(F.lit(1)).alias("n")))
