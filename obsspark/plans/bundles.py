"""Whole bundles as one flat, ordered DataFrame.

Section order (K3):
  service bundle: meta | side records | log lines (ascending rank) |
                  log summary | metrics (registry order)
  pod bundle:     meta | logs per pod/container, current then previous |
                  events per namespace | skipped metrics | scraped metrics
"""

from __future__ import annotations

import json
from dataclasses import asdict
from typing import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsspark.functions.timeparse import ISO_MS_FORMAT
from obsspark.operators import containers as C
from obsspark.operators import events as EV
from obsspark.operators import inventory as INV
from obsspark.operators import metrics as M
from obsspark.params import ContainerLogParams, ServiceLogParams
from obsspark.plans.service_logs import ServiceLogs
from obsspark.session import shared_dir
from obsspark.sources.bundle import conform, int_key, order_key


def _now_iso(now_ms: int):
    return F.date_format(F.timestamp_millis(F.lit(now_ms)), ISO_MS_FORMAT)


def meta_record(spark: SparkSession, bundle_id: str, created_at: str, params: dict) -> DataFrame:
    return conform(spark.range(1).select(
        F.lit(0).alias("section"), F.lit("meta").alias("type"), F.lit(bundle_id).alias("bundle_id"),
        F.lit(created_at).alias("created_at"), F.lit(json.dumps(params, sort_keys=True, default=str)).alias("params")))


def _source_fields(df: DataFrame):
    """file/journal naming of a log source: journal sources name their
    unit (``journal`` column, else the source name in ``file``)."""
    j = F.col("is_journal")
    unit = F.col("journal") if "journal" in df.columns else F.col("file")
    return [F.when(~j, F.col("file")).alias("file"), F.when(j, unit).alias("journal"),
            F.when(j, F.col("journal_scope")).alias("journal_scope"),
            F.when(j, F.col("journal_user") if "journal_user" in df.columns else F.lit(None).cast("string"))
            .alias("journal_user")]


def _tuple_key(df: DataFrame, cols: Sequence[str]):
    """String key ordered like the tuple of ``cols`` (types from ``df``):
    booleans as 0/1, integers zero-padded (non-negative), text as is."""
    types = dict(df.dtypes)
    parts = []
    for c in cols:
        t = types[c]
        if t == "boolean":
            parts.append(F.col(c).cast("int").cast("string"))
        elif t in ("tinyint", "smallint", "int", "bigint"):
            parts.append(int_key(F.col(c)))
        else:
            parts.append(F.col(c))
    return order_key(*parts)


def service_log_records(logs: ServiceLogs, sources: DataFrame, params: ServiceLogParams,
                        keys: Sequence[str], source_order: Sequence[str], order_col=None) -> DataFrame:
    """Side records, selected lines and the summary as flat bundle rows.

    Lines sort by (rank time, source order, arrival order); with a
    multi-column arrival order (e.g. file block, row) the leading columns
    join the source key and the last one is ``k3``."""
    keys, source_order = list(keys), list(source_order)
    order = list(logs.order if order_col is None else ([order_col] if isinstance(order_col, str) else order_col))
    skey = _tuple_key(logs.summary, source_order)
    # The (checkpointed) per-source summary carries every source
    # attribute, so the input sources table is not read again.
    summ = logs.summary
    src = summ.select(*sorted(set(keys) | set(source_order) | {"is_journal", "journal_scope"}
                              | ({"file", "journal", "journal_user"} & set(summ.columns))))
    diag = (logs.diagnostics.join(src, keys)
            .select(F.lit(1).alias("section"), skey.alias("k2"), "type", "service", *_source_fields(src),
                    "ts", "line", "skipped", "reason", "error"))
    sel = logs.selected
    sel_src = sel.join(src.select(*keys, *[c for c in src.columns if c not in sel.columns]), keys)
    line_key = order_key(skey, *[int_key(F.col(c)) for c in order[:-1]]) if len(order) > 1 else skey
    lines = sel_src.select(F.lit(2).alias("section"), F.col("rank_ms").alias("k1"), line_key.alias("k2"),
                           F.col(order[-1]).alias("k3"), F.lit("log").alias("type"), "service",
                           *_source_fields(sel_src), "ts", "line")
    return (conform(diag).unionByName(conform(lines))
            .unionByName(_summary_records(logs.totals, summ, skey, _source_fields(summ), params.now_ms)))


def _summary_records(totals: DataFrame, summ: DataFrame, skey, fields: list, now_ms: int) -> DataFrame:
    """G2 record: totals plus ``sources[]`` in source order, an item a row, so
    that the list is sorted and written like any other rows of the bundle."""
    head = totals.select(
        F.lit(3).alias("section"), F.lit("log_summary").alias("type"), _now_iso(now_ms).alias("ts"), "max_total_log_lines",
        "line_limited", "matched_log_records", "returned_log_records", "diagnostic_records", F.lit(0).alias("part"))
    end = totals.select(F.lit(3).alias("section"), F.lit(2).cast("long").alias("k1"), F.lit("log_summary").alias("type"), F.lit(2).alias("part"))
    first = summ.agg(F.min(skey)).scalar()
    items = summ.select(
        F.lit(3).alias("section"), F.lit(1).cast("long").alias("k1"), skey.alias("k2"), F.when(skey == first, 0).otherwise(1).cast("long").alias("k3"),
        F.lit("log_summary").alias("type"), F.lit(1).alias("part"), "service", *fields,
        "raw_log_records", "matched_log_records", "returned_log_records",
        *[c for c in ("skipped", "reason", "error") if c in summ.columns])
    return conform(head).unionByName(conform(items)).unionByName(conform(end))


def service_metric_records(outcomes: DataFrame, now_ms: int) -> DataFrame:
    return conform(outcomes.select(
        F.lit(4).alias("section"), int_key(F.col("service_idx")).alias("k2"), F.lit("metrics_text").alias("type"),
        "service", "url", _now_iso(now_ms).alias("ts"), "skipped", "reason", "ok", "error", "content"))


def service_bundle(spark: SparkSession, logs: ServiceLogs | None, sources: DataFrame, metrics: DataFrame | None,
                   params: ServiceLogParams, bundle_id: str, created_at: str,
                   keys: Sequence[str] = ("service", "file"),
                   source_order: Sequence[str] = ("service", "is_journal", "file")) -> DataFrame:
    """Meta, then (when logs are included) side records, lines and the
    summary, then (when metrics are included) one record per service."""
    out = meta_record(spark, bundle_id, created_at, {"kind": "services", **asdict(params)})
    if logs is not None:
        out = out.unionByName(service_log_records(logs, sources, params, keys, source_order))
    if metrics is not None:
        out = out.unionByName(service_metric_records(metrics, params.now_ms))
    return out


# ------------------------------------------------------------------ pod bundle

def pod_log_records(lines: DataFrame, skips: DataFrame | None, now_ms: int) -> DataFrame:
    """Container lines (and previous-log skip records) in pod, container,
    current-then-previous, line order."""
    key = order_key(F.col("namespace"), F.col("pod"), int_key(F.col("container_ord")),
                    F.col("previous").cast("int").cast("string"))
    recs = conform(lines.select(F.lit(1).alias("section"), key.alias("k2"), F.col("pos").alias("k3"),
                                F.lit("log").alias("type"), "namespace", "pod", "container", "ts",
                                F.when(F.col("previous"), F.lit(True)).alias("previous"), "line"))
    if skips is not None:
        sk = skips.withColumn("previous", F.lit(True))
        recs = recs.unionByName(conform(sk.select(
            F.lit(1).alias("section"), key.alias("k2"), F.lit(-1).cast("long").alias("k3"),
            F.lit("log").alias("type"), "namespace", "pod", "container", _now_iso(now_ms).alias("ts"),
            "previous", F.lit(True).alias("skipped"), "reason")))
    return recs


def event_records(events: DataFrame) -> DataFrame:
    """Events by namespace and listing order: a stored ``event_id``, else (page, item) as read from JSON."""
    stored = "event_id" in events.columns
    k2 = F.col("namespace") if stored else order_key(F.col("namespace"), F.col("page"))
    involved = F.col("obj_namespace") if "obj_namespace" in events.columns else F.col("namespace")
    return conform(events.select(
        F.lit(2).alias("section"), k2.alias("k2"), F.col("event_id" if stored else "item").cast("long").alias("k3"),
        F.lit("event").alias("type"), "namespace", "ts", "reason", "message",
        F.col("obj_kind").alias("involved_kind"), F.col("obj_name").alias("involved_name"),
        involved.alias("involved_namespace")))


def pod_metric_records(outcomes: DataFrame, now_ms: int) -> DataFrame:
    key = order_key(F.col("namespace"), F.col("pod"))
    sec = F.when(F.col("skipped"), F.lit(3)).otherwise(F.lit(4))
    return conform(outcomes.select(
        sec.alias("section"), key.alias("k2"), F.lit("metrics_text").alias("type"), "namespace", "pod",
        "pod_ip", "port", "path", _now_iso(now_ms).alias("ts"), "skipped", "reason", "ok", "error", "content"))


def pod_bundle(spark: SparkSession, pods: DataFrame, container_logs: DataFrame | None, events: DataFrame | None,
               scrapes: DataFrame | None, params: ContainerLogParams, bundle_id: str, created_at: str,
               namespace: str = "*", selector: str | None = None, max_pods: int | None = None,
               max_metrics_pods: int | None = None, max_body_bytes: int = M.MAX_METRICS_BODY_BYTES,
               timeout_ms: int = M.METRICS_TIMEOUT_MS, requested: DataFrame | None = None,
               entry_time_col: str | None = None, log_errors: DataFrame | None = None) -> DataFrame:
    """Resolve pods (S4/P12/P13, G4 when ``max_pods``), then logs (B2),
    events (B3) and metrics (B4) in bundle order.  Argument/size checks
    run before anything is written, as in the reference.

    ``log_errors`` (namespace, pod, container, previous, status, message): failed
    log reads.  Of the selected pods, one that only says that there is no previous
    container becomes a skip record, any other fails the bundle (P26).  Where
    ``pods`` has its listing order (page, item), events are matched with the uid
    of the last pod of a name (G6); without an order each uid listed counts."""
    if requested is not None:
        # pods[] target: exactly the named pods, every one must exist
        req = requested.select(F.col("namespace").alias("_rns"), F.col("pod").alias("_rpod")).distinct()
        sel = pods.join(req, (F.col("metadata.namespace") == F.col("_rns")) & (F.col("metadata.name") == F.col("_rpod")),
                        "left_semi")
    else:
        sel = pods if selector is None else INV.pods_by_selector(pods, namespace, selector)
    refs = INV.pod_refs(sel)
    INV.assert_pod_identity(refs)
    if requested is not None:
        INV.assert_pods_found(requested, refs)
    if max_pods is not None:
        INV.assert_pod_cap(refs, max_pods)
    out = meta_record(spark, bundle_id, created_at, {"kind": "pods", "namespace": namespace,
                                                     "selector": selector, **asdict(params)})
    if container_logs is not None:
        C.assert_expected_lines(refs, params)
        tailed = C.tail_container_logs(container_logs, refs, params, entry_time_col=entry_time_col)
        if params.previous and params.tail_lines > 0 and entry_time_col is None:
            # records and previous-log checks both read the bounded tail:
            # materialize it once instead of scanning the log table twice
            # (with an entry-time bound the tail no longer proves that a
            # previous container exists, so that case reads the table)
            shared_dir(spark)
            tailed = tailed.checkpoint(eager=True)
            skips = C.previous_skips(container_logs, refs, tailed=tailed)
        else:
            skips = C.previous_skips(container_logs, refs) if params.previous else None
        if log_errors is not None:
            failed = C.fetch_errors_of(log_errors, refs)
            C.assert_no_fatal_fetch_errors(failed)
            if skips is not None:
                skips = skips.unionByName(failed.filter("skipped").select(skips.columns)).dropDuplicates(
                    ["namespace", "pod", "container"])
        lines = C.container_log_lines(container_logs, refs, params, tailed=tailed)
        out = out.unionByName(pod_log_records(lines, skips, params.now_ms))
    if events is not None:
        start_ms, end_ms = params.window_ms()
        uids = refs.select("namespace", "name", "uid")
        if {"page", "item"} <= set(sel.columns):
            listed = INV.pod_refs(sel, keep=("page", "item")).withColumn("_at", F.struct("page", "item"))
            uids = INV.pod_uid_map(listed, "_at")
        ev = EV.collect_events(events, uids, start_ms,
                               end_ms if params.window.is_absolute else None)
        out = out.unionByName(event_records(ev))
    if scrapes is not None:
        targets = M.scrape_targets(refs)
        if max_metrics_pods is not None:
            M.assert_metrics_cap(targets, max_metrics_pods)
        out = out.unionByName(pod_metric_records(
            M.classify_pod_scrapes(targets, scrapes, max_body_bytes, timeout_ms), params.now_ms))
    return out
