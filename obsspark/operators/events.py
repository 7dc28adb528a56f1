"""Kubernetes events: timestamp choice (P20), window (P21) and the
match to selected pods (J1)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def event_timestamp(last="last_timestamp", event="event_time", creation="creation_timestamp") -> Column:
    """P20: first non-null of lastTimestamp, eventTime, creationTimestamp;
    an empty result means none (an empty lastTimestamp does not fall
    through to the next candidate)."""
    c = lambda x: F.col(x) if isinstance(x, str) else x
    return F.nullif(F.coalesce(c(last), c(event), c(creation)), F.lit(""))


def event_window(events: DataFrame, since_ms: int, end_ms: int | None = None, ts: str = "ts") -> DataFrame:
    """Drop events without a parsable time; keep ``time >= since``
    and, for absolute windows only, ``time <= end``."""
    ms = F.unix_millis(F.try_to_timestamp(F.col(ts)))
    cond = ms.isNotNull() & (ms >= F.lit(since_ms))
    if end_ms is not None:
        cond = cond & (ms <= F.lit(end_ms))
    return events.withColumn("ts_ms", ms).filter(cond)


def events_for_pods(events: DataFrame, pod_uids: DataFrame) -> DataFrame:
    """Events whose involved object is a selected pod.

    ``events``: namespace (listing namespace), obj_kind, obj_name,
    obj_uid.  ``pod_uids``: namespace, name, uid (one row per selected
    pod, see ``pod_uid_map``).  Kind must be ``Pod``; the name must be
    a selected pod of the same namespace; uids must agree only when both
    are non-empty.  Planned as a left-semi hash join on
    (namespace, name) with the uid rule as residual.
    """
    ev_uid = F.nullif(F.col("obj_uid"), F.lit(""))
    p = pod_uids.select(F.col("namespace").alias("_p_ns"), F.col("name").alias("_p_name"),
                        F.nullif(F.col("uid"), F.lit("")).alias("_p_uid"))
    cond = ((F.col("namespace") == F.col("_p_ns")) & (F.col("obj_name") == F.col("_p_name"))
            & (F.col("_p_uid").isNull() | ev_uid.isNull() | (ev_uid == F.col("_p_uid"))))
    return events.filter((F.col("obj_kind") == "Pod") & (F.length(F.col("obj_name")) > 0)).join(
        p, cond, "left_semi")


def collect_events(events: DataFrame, pod_uids: DataFrame, since_ms: int, end_ms: int | None,
                   time_col: str | None = None) -> DataFrame:
    """Event records for the selected pods inside the window.

    ``time_col`` (a stored epoch-ms copy of the resolved event time) lets
    the window reach the scan as a pushed filter first; the string rule
    below still decides, so results are unchanged."""
    if time_col is not None:
        pre = F.col(time_col) >= F.lit(since_ms)
        if end_ms is not None:
            pre = pre & (F.col(time_col) <= F.lit(end_ms))
        events = events.filter(pre)
    ev = events.withColumn("ts", event_timestamp())
    ev = event_window(ev, since_ms, end_ms)
    return events_for_pods(ev, pod_uids)
