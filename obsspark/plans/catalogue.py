"""The query catalogue: one Spark query per implemented operator.

Each entry takes ``(spark, sf_dir)`` and returns a DataFrame over the
driver's tables (reshaped by ``obsspark.sources.fixtures``).  The
matching DuckDB statement lives in ``ORACLE`` (same column names).
Parameters are fixed here so both engines compute the same thing.
"""

from __future__ import annotations

import datetime
from typing import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from obsspark.functions.text import is_journal_noise
from obsspark.operators import access as A
from obsspark.operators import containers as C
from obsspark.operators import events as EV
from obsspark.operators import inventory as INV
from obsspark.operators import metrics as M
from obsspark.operators import templates as TM
from obsspark.operators import triage as TR
from obsspark.operators.diagnostics import USER_JOURNAL_PERMISSION_TEXT, classify_source_errors, journal_user_errors, without_journal
from obsspark.operators.lines import (
    drop_empty, drop_journal_noise, filter_text, inherit_timestamp, parse_lines,
    since_filter, tail_per_source, time_window_lenient, time_window_strict)
from obsspark.operators.rank import final_order
from obsspark.params import ContainerLogParams, ServiceLogParams, TimeWindow
from obsspark.plans import oracle as O
from obsspark.plans.bundles import pod_bundle, service_bundle
from obsspark.plans.discovery import discover_pods
from obsspark.plans.service_logs import collect_service_logs
from obsspark.session import ensure_session_defaults, shared_dir
from obsspark.sources import fixtures as FX
from obsspark.sources.bundle import read_bundle, write_bundle
from obsspark.sources.files import file_source_lines, write_source_files
from obsspark.sources.journal import journal_source_lines, journal_with_fallback
from obsspark.sources.kube import read_container_logs, read_events, read_pods
from obsspark.sources.registry import parse_services
from obsspark.sources.scrapes import read_scrapes

# Fixed catalogue parameters.
NOW_MS = 1_706_659_200_000                      # 2024-01-31T00:00:00Z
WINDOW = TimeWindow(start="2024-01-10T00:00:00Z", end="2024-01-20T00:00:00Z",
                    max_seconds=31 * 86_400)
WIN_START_MS, WIN_END_MS = WINDOW.bounds_ms(NOW_MS)
TAIL = 150
INCLUDE = ("error", "click", "VIEW")
EXCLUDE = ('"k": 13}', "user=42 ")
TOP_K = 500

SERVICE_PARAMS = ServiceLogParams(now_ms=NOW_MS, tail_lines=TAIL, include=INCLUDE, exclude=EXCLUDE,
                                  window=WINDOW, max_total_log_lines=TOP_K)

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def register(name: str, sql: str | None):
    def deco(fn):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ensure_session_defaults(spark)
            return fn(spark, sf_dir)
        run.__name__ = fn.__name__
        run.__doc__ = fn.__doc__
        QUERIES[name] = run
        if sql is not None:
            ORACLE[name] = sql
        return run
    return deco


# ---------------------------------------------------------------- F1 lines

def f1_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sources of F1 with the registry's journal scope for journal roles.

    Derived from the whole line table (a distinct over it)."""
    reg = FX.services(spark, sf_dir).select(F.col("name").alias("service"), F.col("journal_scope").alias("_scope"))
    src = (FX.log_lines(spark, sf_dir).select("service", "file", "is_journal").distinct()
           .join(reg, "service", "left")
           .select("service", "file", "is_journal",
                   F.when(F.col("is_journal"), F.col("_scope")).alias("journal_scope")))
    return src


def service_logs(spark: SparkSession, sf_dir: str, params: ServiceLogParams = SERVICE_PARAMS,
                 materialize: bool = True):
    """B1 over F1."""
    return collect_service_logs(FX.log_lines(spark, sf_dir), f1_sources(spark, sf_dir),
                                FX.source_errors(spark, sf_dir), params, materialize=materialize)


_W = f"sort_ms between {WIN_START_MS} and {WIN_END_MS}"


@register("parse_line", f"""with f1 as ({O.F1}),
p as ({O.parsed_cte("(select * from f1 where length(raw) > 0) s")})
select service, file, seq, ts, line, sort_ms from p""")
def q_parse_line(spark, d):
    """Split valid leading timestamps off non-empty lines."""
    return parse_lines(drop_empty(FX.log_lines(spark, d))).select("service", "file", "seq", "ts", "line", "sort_ms")


@register("include_exclude", f"""with f1 as ({O.F1})
select service, file, seq, raw from f1
where length(raw) > 0 and {O.any_contains('raw', INCLUDE)} and not {O.any_contains('raw', EXCLUDE)}""")
def q_include_exclude(spark, d):
    """Include-any and exclude-any substring filters on raw lines."""
    return filter_text(drop_empty(FX.log_lines(spark, d)), INCLUDE, EXCLUDE).select("service", "file", "seq", "raw")


@register("journal_noise", f"""with f1 as ({O.F1})
select service, file, seq, raw from f1 where is_journal and not {O.NOISE}""")
def q_journal_noise(spark, d):
    """P10: journal lines without blank lines and "No entries" markers."""
    return drop_journal_noise(FX.log_lines(spark, d).filter("is_journal")).select("service", "file", "seq", "raw")


@register("time_window_lenient", f"""with f1 as ({O.F1}),
p as ({O.parsed_cte("(select * from f1 where length(raw) > 0) s")})
select service, file, seq, sort_ms from p
where not is_journal or sort_ms is null or {_W}""")
def q_time_window_lenient(spark, d):
    """P5: inclusive window on journal lines; NULL timestamps and file lines pass."""
    p = parse_lines(drop_empty(FX.log_lines(spark, d)))
    return (time_window_lenient(p, WIN_START_MS, WIN_END_MS, applies=F.col("is_journal"))
            .select("service", "file", "seq", "sort_ms"))


@register("tail_per_source", f"""with f1 as ({O.F1})
select service, file, seq, from_end from (
  select service, file, seq, row_number() over (partition by service, file order by seq desc) as from_end from f1)
where from_end <= {TAIL}""")
def q_tail_per_source(spark, d):
    """Last N physical lines of every source."""
    return (tail_per_source(FX.log_lines(spark, d), ["service", "file"], "seq", TAIL, rank_col="from_end")
            .select("service", "file", "seq", "from_end"))


@register("inherit_timestamp", f"""with f1 as ({O.F1}),
p as ({O.parsed_cte(f"(select * from f1 where length(raw) > 0 and (not is_journal or not {O.NOISE})) s")})
select service, file, seq, sort_ms,
       coalesce(sort_ms, last_value(case when sort_ms is not null and (not is_journal or {_W}) then sort_ms end ignore nulls)
                over (partition by service, file order by seq rows between unbounded preceding and current row)) as rank_ms
from p""")
def q_inherit_timestamp(spark, d):
    """Untimestamped lines take the last in-window timestamp of their source."""
    l0 = drop_empty(FX.log_lines(spark, d))
    l0 = l0.filter(~F.col("is_journal") | ~is_journal_noise(F.col("raw")))
    return (inherit_timestamp(parse_lines(l0), ["service", "file"], "seq", WIN_START_MS, WIN_END_MS,
                              window_applies=F.col("is_journal"))
            .select("service", "file", "seq", "sort_ms", "rank_ms"))


def _b1_ctes(params: ServiceLogParams = SERVICE_PARAMS, entry_filter: str | None = None) -> str:
    s, e = params.window_ms()
    now_iso = _iso_ms(params.now_ms)
    return O.service_logs_ctes(params.tail_lines, s, e, params.include, params.exclude,
                               params.max_total_log_lines, USER_JOURNAL_PERMISSION_TEXT, now_iso, entry_filter)


def _iso_ms(ms: int) -> str:
    t = datetime.datetime.fromtimestamp(ms / 1000, tz=datetime.timezone.utc)
    return t.strftime("%Y-%m-%dT%H:%M:%S.") + f"{t.microsecond // 1000:03d}Z"


@register("newest_lines", f"""with {_b1_ctes()}
select service, file, seq, ts, line, rank_ms from sel""")
def q_newest_lines(spark, d):
    """K1, K2 (B1): global top-K lines by rank time across all sources."""
    return service_logs(spark, d).newest.select("service", "file", "seq", "ts", "line", "rank_ms")


@register("journal_entry_window", f"""with {_b1_ctes(entry_filter=(
        f"entry_ts between epoch_ms({WIN_START_MS}) and epoch_ms({WIN_END_MS})"))}
select service, file, seq, ts, line, rank_ms from sel""")
def q_journal_entry_window(spark, d):
    """B1 with journal entries selected by their own time (a pushed-down
    scan predicate) before the lenient line window."""
    logs = collect_service_logs(FX.log_lines(spark, d), f1_sources(spark, d), FX.source_errors(spark, d),
                                SERVICE_PARAMS, entry_time_col="entry_ts")
    return logs.newest.select("service", "file", "seq", "ts", "line", "rank_ms")


@register("source_summary", f"""with {_b1_ctes()}
select service, file, is_journal, raw_log_records, matched_log_records, returned_log_records,
       skipped, reason, error from summ""")
def q_source_summary(spark, d):
    """G1 (B1): per-source raw / matched / returned counts and skip reasons."""
    return service_logs(spark, d).summary.select(
        "service", "file", "is_journal", "raw_log_records", "matched_log_records", "returned_log_records",
        "skipped", "reason", "error")


@register("log_summary", f"""with {_b1_ctes()},
tot as (select count(*) as n_sources, coalesce(sum(matched_log_records), 0) as m,
               coalesce(sum(returned_log_records), 0) as r from summ)
select cast({TOP_K} as bigint) as max_total_log_lines, m > r as line_limited,
       cast(m as bigint) as matched_log_records, cast(r as bigint) as returned_log_records,
       (select count(*) from diag) as diagnostic_records, n_sources
from tot where n_sources > 0""")
def q_log_summary(spark, d):
    """G2 (B1): bundle-level totals of the log section."""
    return service_logs(spark, d).totals


@register("missing_sources", f"""with {_b1_ctes()}
select service, file, type, ts, line, skipped, reason, error from diag""")
def q_missing_sources(spark, d):
    """J4, J5 (B1): diagnostic records for failed sources and empty user journals."""
    return service_logs(spark, d).diagnostics


def _written_files(spark, d):
    """F1's lines as one text file per source in the shared folder: (service, file, path)."""
    return write_source_files(FX.log_lines(spark, d), shared_dir(spark, "log-files"), ["service", "file"], ["seq"])


@register("log_files", f"""with f1 as ({O.F1})
select service, file, raw, null::varchar as code from f1
union all
select distinct service, file || '.1', null, 'ENOENT' from f1""")
def q_log_files(spark, d):
    """Text files of many byte ranges read by tasks; for each source a rotated file that is not there."""
    found = _written_files(spark, d)
    rotated = found.select("service", F.concat("file", F.lit(".1")).alias("file"), F.concat("path", F.lit(".1")).alias("path"))
    lines, errors = file_source_lines(spark, found.unionByName(rotated), ("service", "file"), "path", split_bytes=4096)
    none = F.lit(None).cast("string")
    return (lines.select("service", "file", "raw", none.alias("code"))
            .unionByName(errors.select("service", "file", none.alias("raw"), "code")))


@register("file_tails", f"""with f1 as ({O.F1})
select service, file, raw, from_end from (
  select service, file, raw, row_number() over (partition by service, file order by seq desc) as from_end from f1)
where from_end <= {TAIL}""")
def q_file_tails(spark, d):
    """The last N physical lines of text files, read from their ends."""
    lines, _ = file_source_lines(spark, _written_files(spark, d), ("service", "file"), "path", tail_lines=TAIL, split_bytes=4096)
    newest = F.row_number().over(Window.partitionBy("service", "file").orderBy(F.desc("block"), F.desc("row")))
    return lines.select("service", "file", "raw", newest.cast("long").alias("from_end"))


# ------------------------------------------------------------ services (F2)


SELECT_NAMES = ["svc-1", "svc-3", "svc-6", "svc-9", "svc-3"]
REQUEST_NAMES = ["svc-1", "svc-9", "svc-x", "svc-3"]


def _names_sql(names) -> str:
    return ", ".join(f"'{n}'" for n in sorted(set(names)))


_FILES_CTE = "files as (select service as name, list_sort(list(distinct file)) as logs from f1 where not is_journal group by 1)"


@register("services_select", f"""with f1 as ({O.F1}), f2 as ({O.F2}), {_FILES_CTE}
select f2.service_idx, f2.name, journal, journal_scope, metrics, cast(coalesce(len(logs), 0) as bigint) as n_logs
from f2 left join files using (name) where f2.name in ({_names_sql(SELECT_NAMES)})""")
def q_services_select(spark, d):
    """Named services of the registry, registry order kept."""
    reg = INV.select_services(FX.registry(spark, d), SELECT_NAMES)
    return reg.select("service_idx", "name", "journal", "journal_scope", "metrics",
                      F.coalesce(F.size(F.coalesce("logs", F.array().cast("array<string>"))), F.lit(0))
                      .cast("long").alias("n_logs"))


@register("expand_sources", f"""with f1 as ({O.F1}), f2 as ({O.F2}),
fl as (select distinct service, file from f1 where not is_journal),
fr as (select f2.service_idx, f2.name as service,
              cast(row_number() over (partition by f2.name order by fl.file) - 1 as int) as source_pos,
              fl.file, cast(null as varchar) as journal, false as is_journal, cast(null as varchar) as journal_scope
       from f2 join fl on fl.service = f2.name),
jr as (select f2.service_idx, f2.name as service,
              cast((select count(*) from fl where fl.service = f2.name) as int) as source_pos,
              cast(null as varchar) as file, journal, true as is_journal, coalesce(journal_scope, 'system') as journal_scope
       from f2 where journal is not null)
select * from fr union all select * from jr""")
def q_expand_sources(spark, d):
    """Registry entries -> ordered sources (files, then the journal)."""
    return INV.expand_sources(FX.registry(spark, d)).select(
        "service_idx", "service", "source_pos", "file", "journal", "is_journal", "journal_scope")


@register("unknown_services", f"""with f2 as ({O.F2})
select name from (values {', '.join(f"('{n}')" for n in sorted(set(REQUEST_NAMES)))}) t(name)
where name not in (select name from f2)""")
def q_unknown_services(spark, d):
    """Requested service names missing from the registry."""
    return INV.unknown_services(spark, FX.registry(spark, d), REQUEST_NAMES)


def _dt(x):
    return O.dtrim(x)


@register("registry_violations", f"""with f1 as ({O.F1}), f2 as ({O.F2}), {_FILES_CTE},
reg as (select f2.service_idx, f2.name, files.logs, journal, journal_scope, cast(null as varchar) as journal_user, metrics
        from f2 left join files using (name))
select service_idx, '{INV.RULE_NAME}' as rule from reg where name is null or {_dt('name')} = ''
union all select service_idx, '{INV.RULE_LOGS}' from reg where len(list_filter(coalesce(logs, []), lambda x: x is null or {_dt('x')} = '')) > 0
union all select service_idx, '{INV.RULE_JOURNAL}' from reg where journal is not null and {_dt('journal')} = ''
union all select service_idx, '{INV.RULE_SCOPE}' from reg where journal_scope is not null and {_dt('journal_scope')} not in ('system', 'user')
union all select service_idx, '{INV.RULE_USER}' from reg where journal_user is not null and ({_dt('journal_user')} = ''
          or (regexp_matches({_dt('journal_user')}, '^[0-9]+$') and cast({_dt('journal_user')} as decimal(20,0)) > {INV.MAX_UID}))
union all select service_idx, '{INV.RULE_SCOPE_NEEDS_JOURNAL}' from reg where journal_scope is not null and (journal is null or {_dt('journal')} = '')
union all select service_idx, '{INV.RULE_USER_REQUIRED}' from reg where {_dt('journal_scope')} = 'user' and (journal_user is null or {_dt('journal_user')} = '')
union all select service_idx, '{INV.RULE_USER_NEEDS_SCOPE}' from reg where coalesce({_dt('journal_scope')}, '') <> 'user' and journal_user is not null and {_dt('journal_user')} <> ''
union all select service_idx, '{INV.RULE_METRICS}' from reg where metrics is not null and {_dt('metrics')} = ''
union all select r.service_idx, '{INV.RULE_DUPLICATE}' from reg r
          where exists (select 1 from reg q where {_dt('q.name')} = {_dt('r.name')} and q.service_idx < r.service_idx)""")
def q_registry_violations(spark, d):
    """Registry rule violations, one row per (entry, rule)."""
    return INV.registry_violations(FX.registry(spark, d))


@register("classify_source_error", f"""with f1 as ({O.F1}), f7 as ({O.F7}),
src as (select distinct service, file, is_journal from f1),
e as (select f7.*, src.is_journal from f7 join src using (service, file)),
s as (select *, case when is_journal then 'system' end as journal_scope, 'system' as scope from e
      union all select *, case when is_journal then 'user' end as journal_scope, 'user' as scope from e),
r as (select *, {O.error_reason()} as reason from s)
select service, file, code, scope, reason, {O.error_text(USER_JOURNAL_PERMISSION_TEXT)} as error,
       case when is_journal and journal_scope = 'user' then 'log_error' else 'log' end as type from r""")
def q_classify_source_error(spark, d):
    """Failed reads -> skip reason and error text, for system and user scopes."""
    src = FX.log_lines(spark, d).select("service", "file", "is_journal").distinct()
    e = FX.source_errors(spark, d).join(src, ["service", "file"])
    both = None
    for scope in ("system", "user"):
        part = e.withColumns({"journal_scope": F.when(F.col("is_journal"), F.lit(scope)), "scope": F.lit(scope)})
        both = part if both is None else both.unionByName(part)
    return classify_source_errors(both).select("service", "file", "code", "scope", "reason", "error", "type")


@register("journal_fallback", f"""with f1 as ({O.F1}), f2 as ({O.F2}),
jl as (select * from f1 where is_journal and not {O.NOISE}),
pr as (select * from jl where service in (select name from f2 where journal is not null))
select service, file, seq, 'primary' as via from pr
union all
select service, file, seq, 'fallback' as via from jl
where not exists (select 1 from pr where pr.service = jl.service and pr.file = jl.file)""")
def q_journal_fallback(spark, d):
    """Primary selector (services with a registered unit) else the fallback selector."""
    jl = drop_journal_noise(FX.log_lines(spark, d).filter("is_journal"))
    units = FX.services(spark, d).filter(F.col("journal").isNotNull()).select(F.col("name").alias("service"))
    primary = jl.join(units, "service", "left_semi")
    return journal_with_fallback(primary, jl, ["service", "file"]).select("service", "file", "seq", "via")


# ------------------------------------------------------------------ pods

POD_NS = "ns-1"
POD_SELECTOR = "app in (building, machinery), tier!=frontend"
POD_NEEDLE = "12"


def pod_objects(spark, d):
    return FX.pod_objects(spark, d)


def all_refs(spark, d):
    return INV.pod_refs(pod_objects(spark, d))


@register("pods_by_selector", f"""with f3 as ({O.F3})
select namespace, name from f3
where namespace = '{POD_NS}' and label_app in ('building', 'machinery') and (label_tier is null or label_tier <> 'frontend')""")
def q_pods_by_selector(spark, d):
    """Namespace scope plus a set-based label selector."""
    p = INV.pods_by_selector(pod_objects(spark, d), POD_NS, POD_SELECTOR)
    return p.select(F.col("metadata.namespace").alias("namespace"), F.col("metadata.name").alias("name"))


@register("pods_by_name", f"""with f3 as ({O.F3})
select namespace, name from f3 where contains(coalesce(name, ''), '{POD_NEEDLE}')""")
def q_pods_by_name(spark, d):
    """Pods whose name contains a substring."""
    p = INV.pods_by_name(pod_objects(spark, d), POD_NEEDLE)
    return p.select(F.col("metadata.namespace").alias("namespace"), F.col("metadata.name").alias("name"))


@register("describe_pods", f"""with f3 as ({O.F3})
select namespace, name, label_app, label_tier, 'main' as containers, ready,
       case when ready then 'Running' else 'Pending' end as phase, pod_ip,
       cast((ann_scrape is not null)::int + (ann_port is not null)::int + (ann_path is not null)::int as int) as n_annotations,
       'node-' || namespace as node_name
from f3""")
def q_describe_pods(spark, d):
    """Admin discovery listing (labels, containers, readiness, phase, podIP, annotations, node)."""
    p = INV.describe_pods(pod_objects(spark, d), admin=True)
    return p.select("namespace", "name", F.col("labels")["app"].alias("label_app"),
                    F.col("labels")["tier"].alias("label_tier"),
                    F.array_join("containers", ",").alias("containers"), "ready", "phase", "pod_ip",
                    F.size("annotations").alias("n_annotations"), "node_name")


@register("pod_refs", f"""with f3 as ({O.F3})
select namespace, name, nullif(uid, '') as uid, pod_ip,
       case when init_container is null then 'main' else 'main,init' end as containers
from f3""")
def q_pod_refs(spark, d):
    """Pod references with containers ++ initContainers."""
    r = all_refs(spark, d)
    return r.select("namespace", "name", "uid", "pod_ip", F.array_join("containers", ",").alias("containers"))


_REQ_REFS_SQL = "select distinct 'ns-' || cast(o_orderkey % 5 as varchar) as namespace, 'pod-' || cast(o_custkey as varchar) as pod from orders"


def requested_refs(spark, d):
    """Pods named by orders in the order's shard namespace (not always the pod's)."""
    o = FX.table(spark, d, "orders")
    return o.select(F.concat(F.lit("ns-"), (F.col("o_orderkey") % 5).cast("string")).alias("namespace"),
                    F.concat(F.lit("pod-"), F.col("o_custkey").cast("string")).alias("pod")).distinct()


@register("missing_pods", f"""with f3 as ({O.F3}), req as ({_REQ_REFS_SQL})
select namespace, pod from req where not exists (select 1 from f3 where f3.namespace = req.namespace and f3.name = req.pod)""")
def q_missing_pods(spark, d):
    """Requested pod references that do not exist."""
    return INV.missing_pods(requested_refs(spark, d), all_refs(spark, d))


@register("pod_uid_map", f"""with f3 as ({O.F3}), f4 as ({O.F4}),
obs as (select namespace, name, uid, cast(0 as bigint) as ord from f3
        union all select namespace, obj_name as name, obj_uid as uid, event_id + 1 as ord from f4 where obj_kind = 'Pod')
select namespace, name, arg_max_null(uid, ord) as uid from obs group by namespace, name""")
def q_pod_uid_map(spark, d):
    """Last observed uid per (namespace, pod) wins."""
    pods = all_refs(spark, d).select("namespace", "name", "uid", F.lit(0).cast("long").alias("ord"))
    ev = (FX.kube_events(spark, d).filter(F.col("obj_kind") == "Pod")
          .select("namespace", F.col("obj_name").alias("name"), F.col("obj_uid").alias("uid"),
                  (F.col("event_id") + 1).alias("ord")))
    return INV.pod_uid_map(pods.unionByName(ev), "ord")


# ---------------------------------------------------------------- events

EVENT_WINDOW = TimeWindow(start="1996-01-01T00:00:00Z", end="1999-12-31T00:00:00Z", max_seconds=10 * 366 * 86_400)
EV_START_MS, EV_END_MS = EVENT_WINDOW.bounds_ms(NOW_MS)
EVENT_SELECTOR = "app=building"


@register("events_for_pods", f"""with f3 as ({O.F3}), f4 as ({O.F4}),
sel as (select namespace, name, uid from f3 where label_app = 'building'),
ev as (select *, nullif(coalesce(last_timestamp, event_time, creation_timestamp), '') as ts from f4),
ev2 as (select *, epoch_ms(try_cast(replace(ts, 'Z', '') as timestamp)) as ms from ev)
select event_id, namespace, ts, reason, message, obj_kind, obj_name from ev2
where ms is not null and ms >= {EV_START_MS} and ms <= {EV_END_MS} and obj_kind = 'Pod' and length(obj_name) > 0
  and exists (select 1 from sel where sel.namespace = ev2.namespace and sel.name = ev2.obj_name
              and (nullif(sel.uid, '') is null or nullif(ev2.obj_uid, '') is null or sel.uid = ev2.obj_uid))""")
def q_events_for_pods(spark, d):
    """J1, P20, P21 (B3): events of selected pods inside an absolute window, uid rule applied."""
    refs = INV.pod_refs(INV.pods_by_selector(pod_objects(spark, d), "*", EVENT_SELECTOR))
    ev = EV.collect_events(FX.kube_events(spark, d), refs.select("namespace", "name", "uid"), EV_START_MS, EV_END_MS)
    return ev.select("event_id", "namespace", "ts", "reason", "message", "obj_kind", "obj_name")


# -------------------------------------------------------- container logs

CONTAINER_PARAMS = ContainerLogParams(
    now_ms=NOW_MS, tail_lines=40, previous=True, exclude=("purchase",),
    window=TimeWindow(start="2024-01-05T00:00:00Z", end="2024-01-25T00:00:00Z", max_seconds=31 * 86_400))
CL_START_MS, CL_END_MS = CONTAINER_PARAMS.window_ms()
CONTAINER_SELECTOR = "tier=backend"

_PC_SQL = """select namespace, name as pod, 'main' as container from {src}
union all select namespace, name as pod, init_container as container from {src} where init_container is not null"""


@register("container_logs_window", f"""with f3 as ({O.F3}), f5 as ({O.F5}),
sel as (select * from f3 where label_tier = 'backend'),
pc as ({_PC_SQL.format(src='sel')}),
w as (select f5.* from f5 join pc using (namespace, pod, container)),
t as (select * from (select *, row_number() over (partition by namespace, pod, container, previous order by pos desc) as rn
                     from w) x where rn <= {CONTAINER_PARAMS.tail_lines}),
p as ({O.parsed_cte("(select * from t where length(raw) > 0) s")})
select namespace, pod, container, previous, pos, ts, line from p
where sort_ms between {CL_START_MS} and {CL_END_MS} and not {O.any_contains('raw', CONTAINER_PARAMS.exclude)}""")
def q_container_logs_window(spark, d):
    """Per-container tail of current and previous logs, strict window, excludes."""
    refs = INV.pod_refs(INV.pods_by_selector(pod_objects(spark, d), "*", CONTAINER_SELECTOR))
    out = C.container_log_lines(FX.container_logs(spark, d), refs, CONTAINER_PARAMS)
    return out.select("namespace", "pod", "container", "previous", "pos", "ts", "line")


@register("since_filter", f"""with f5 as ({O.F5}),
p as ({O.parsed_cte("(select * from f5 where length(raw) > 0) s")})
select namespace, pod, pos, sort_ms from p where sort_ms is null or sort_ms >= {NOW_MS - 7 * 86_400 * 1000}""")
def q_since_filter(spark, d):
    """Relative lower bound now - since on container lines; undated lines kept."""
    p = parse_lines(drop_empty(FX.container_logs(spark, d)))
    return since_filter(p, NOW_MS, 7 * 86_400).select("namespace", "pod", "pos", "sort_ms")


@register("time_window_strict", f"""with f5 as ({O.F5}),
p as ({O.parsed_cte("(select * from f5 where length(raw) > 0) s")})
select namespace, pod, pos, sort_ms from p where sort_ms between {CL_START_MS} and {CL_END_MS}""")
def q_time_window_strict(spark, d):
    """Inclusive absolute window; undated lines dropped."""
    p = parse_lines(drop_empty(FX.container_logs(spark, d)))
    return time_window_strict(p, CL_START_MS, CL_END_MS).select("namespace", "pod", "pos", "sort_ms")


@register("previous_skips", f"""with f3 as ({O.F3}), f5 as ({O.F5}),
pc as ({_PC_SQL.format(src='f3')}),
prev as (select distinct namespace, pod, container from f5 where previous)
select namespace, pod, container, '{C.NO_PREVIOUS_CONTAINER}' as reason from pc
where not exists (select 1 from prev where prev.namespace = pc.namespace and prev.pod = pc.pod and prev.container = pc.container)""")
def q_previous_skips(spark, d):
    """Containers asked for previous logs that have none -> skip records."""
    return C.previous_skips(FX.container_logs(spark, d), all_refs(spark, d)).select(
        "namespace", "pod", "container", "reason")


@register("expected_lines", f"""with f3 as ({O.F3})
select count(*) as n_pods, cast(sum(case when init_container is null then 1 else 2 end) as bigint) as n_containers,
       cast(sum(case when init_container is null then 1 else 2 end) * 4000 as bigint) as expected_max
from f3 where label_app = 'building'""")
def q_expected_lines(spark, d):
    """Containers x tailLines x 2 (previous) for the selected pods."""
    refs = INV.pod_refs(INV.pods_by_selector(pod_objects(spark, d), "*", EVENT_SELECTOR))
    return C.expected_lines(refs, 2000, True)


# --------------------------------------------------------------- metrics

MAX_BODY = 12

_PORT_SQL = "try_cast(nullif(regexp_extract(ann_port, '^\\s*([+-]?[0-9]+)', 1), '') as bigint)"
_PATH_T = O.dtrim("ann_path")
_TARGETS_SQL = f"""t0 as (select *, {_PORT_SQL} as port0 from f3),
t1 as (select *, coalesce(ann_scrape = 'true', false) and coalesce(port0 > 0, false) as metrics_enabled from t0),
tg as (select *, case when metrics_enabled then port0 end as port,
              case when metrics_enabled then (case when {_PATH_T} <> '' and starts_with({_PATH_T}, '/')
                   and not contains({_PATH_T}, '..') and not contains({_PATH_T}, '?') and not contains({_PATH_T}, '#')
                   then {_PATH_T} else '/metrics' end) end as path from t1),
tgu as (select *, case when metrics_enabled and coalesce(pod_ip <> '', false)
               then 'http://' || pod_ip || ':' || cast(port as varchar) || path end as url from tg)"""


@register("scrape_targets", f"""with f3 as ({O.F3}), {_TARGETS_SQL}
select namespace, name, metrics_enabled, port, path, url from tgu""")
def q_scrape_targets(spark, d):
    """Annotation-driven scrape targets, port prefix parse, path rules, URL."""
    return M.scrape_targets(all_refs(spark, d)).select("namespace", "name", "metrics_enabled", "port", "path", "url")


def _outcome_sql(fetch_failed: str) -> tuple[str, str]:
    size = "octet_length(encode(body))"
    err = (f"(case when error_kind = 'timeout' then 'timeout after 2000ms' "
           f"when error_kind is not null or http_status is null then {fetch_failed} "
           f"when coalesce({size}, 0) > {MAX_BODY} then 'response_too_large (' || cast({size} as varchar) || ' bytes)' "
           f"when http_status not between 200 and 299 then 'non-200 (' || cast(http_status as varchar) || ')' end)")
    return f"({err} is null)", err


_OK, _ERR = _outcome_sql("'fetch_failed'")


@register("classify_pod_scrape", f"""with f3 as ({O.F3}), f6 as ({O.F6}), {_TARGETS_SQL},
j as (select tgu.*, f6.http_status, f6.body, f6.error_kind, f6.error_message
      from tgu left join f6 on f6.namespace = tgu.namespace and f6.pod = tgu.name),
k as (select *, metrics_enabled and coalesce(pod_ip <> '', false) as fetched, {_OK} as ok0, {_ERR} as err0 from j)
select namespace, name as pod,
       case when fetched then pod_ip end as pod_ip, case when fetched then port end as port,
       case when fetched then path end as path,
       case when not metrics_enabled then true end as skipped,
       case when not metrics_enabled then 'annotation_missing' end as reason,
       case when metrics_enabled and not fetched then false when fetched then ok0 end as ok,
       case when metrics_enabled and not fetched then 'podIP_missing' when fetched then err0 end as error,
       case when fetched and ok0 then coalesce(body, '') end as content
from k""")
def q_classify_pod_scrape(spark, d):
    """P22, J6 (B4): exactly one metrics outcome per pod, reference precedence."""
    t = M.scrape_targets(all_refs(spark, d))
    return M.classify_pod_scrapes(t, FX.scrapes(spark, d), max_body_bytes=MAX_BODY).select(
        "namespace", "pod", "pod_ip", "port", "path", "skipped", "reason", "ok", "error", "content")


_SOK, _SERR = _outcome_sql("'fetch_failed: ' || coalesce(error_message, 'unknown')")


@register("classify_service_scrape", f"""with f2 as ({O.F2}), f6 as ({O.F6}),
ss as (select f2.name as service, f6.http_status, f6.body, f6.error_kind, f6.error_message from f2
       join f6 on f6.namespace = 'ns-' || cast(f2.service_idx % 5 as varchar) and f6.pod = 'pod-' || cast(f2.service_idx as varchar)),
j as (select f2.service_idx, f2.name, f2.metrics, ss.* exclude (service) from f2 left join ss on ss.service = f2.name)
select service_idx, name as service, metrics as url,
       case when metrics is null then true end as skipped,
       case when metrics is null then 'no_metrics_url' end as reason,
       case when metrics is not null then {_SOK} end as ok,
       case when metrics is not null then {_SERR} end as error,
       case when metrics is not null and {_SOK} then coalesce(body, '') end as content
from j""")
def q_classify_service_scrape(spark, d):
    """P22, J6b (B5): exactly one metrics outcome per registered service."""
    return M.classify_service_scrapes(FX.registry(spark, d), FX.service_scrapes(spark, d), max_body_bytes=MAX_BODY
                                      ).select("service_idx", "service", "url", "skipped", "reason", "ok", "error",
                                               "content")


# ---------------------------------------------------------------- access (F8)

def principals(spark, d, pattern_col: str, out_col: str):
    """F8 folded to one row per principal (admin, patterns array)."""
    return A.fold_patterns(FX.principal_patterns(spark).filter(F.col(pattern_col).isNotNull() | F.col("admin")),
                           pattern_col, out_col)


def _glob_sql(value: str, pattern: str) -> str:
    p = f"replace(replace(replace(replace({pattern}, '!', '!!'), '%', '!%'), '_', '!_'), '*', '%')"
    return f"({value} like {p} escape '!')"


@register("visible_services", f"""with f2 as ({O.F2}), f8 as ({O.F8}),
pr as (select distinct sub, admin from f8)
select pr.sub, f2.name, f2.service_idx,
       case when pr.admin then f2.journal end as journal,
       case when pr.admin then f2.journal_scope end as journal_scope,
       case when pr.admin then f2.metrics end as metrics
from pr join f2 on pr.admin or exists (select 1 from f8 where f8.sub = pr.sub and f8.svc_pattern is not null
                                        and {_glob_sql('f2.name', 'f8.svc_pattern')})""")
def q_visible_services(spark, d):
    """Services each principal may list, admin fields redacted for others."""
    pr = principals(spark, d, "svc_pattern", "allowed_services")
    return A.visible_services(pr, FX.services(spark, d))


@register("authorize_targets", f"""with f3 as ({O.F3}), f8 as ({O.F8}),
t as (select distinct namespace as target from f3 union select '*'),
pr as (select distinct sub, admin from f8),
ok as (select pr.sub, t.target from pr join t on pr.admin or exists (
          select 1 from f8 where f8.sub = pr.sub and f8.ns_pattern is not null and {_glob_sql('t.target', 'f8.ns_pattern')}))
select pr.sub, (select count(*) from t) as n_targets, count(ok.target) as n_allowed,
       count(ok.target) = (select count(*) from t) as authorized
from pr left join ok on ok.sub = pr.sub group by pr.sub""")
def q_authorize_targets(spark, d):
    """All-or-nothing namespace authorization per principal ('*' target must be matched itself)."""
    pr = principals(spark, d, "ns_pattern", "allowed_namespaces")
    targets = (all_refs(spark, d).select(F.col("namespace").alias("target"))
               .unionByName(spark.range(1).select(F.lit("*").alias("target"))))
    return A.authorize_targets(pr, "allowed_namespaces", targets, "target")


@register("authorize_capabilities", f"""with f4 as ({O.F4}), f5 as ({O.F5}), f6 as ({O.F6}), f8 as ({O.F8}),
caps as ({O.F8_CAPS}),
rec as (select 'event' as type, namespace from f4 union all select 'log', namespace from f5
        union all select 'metrics_text', namespace from f6),
cm as (select * from (values ('log', 'logs'), ('log_error', 'logs'), ('log_summary', 'logs'), ('event', 'events'),
                             ('metrics_text', 'metrics')) t(type, capability)),
pr as (select distinct sub, admin from f8)
select pr.sub, rec.type, count(*) as n_records
from pr join rec on pr.admin or (exists (select 1 from f8 where f8.sub = pr.sub and f8.ns_pattern is not null
                                          and {_glob_sql('rec.namespace', 'f8.ns_pattern')})
                                  and exists (select 1 from caps join cm on cm.capability = caps.capability
                                              where caps.sub = pr.sub and cm.type = rec.type))
group by pr.sub, rec.type""")
def q_authorize_capabilities(spark, d):
    """Records per (principal, type) visible by capability and namespace scope."""
    pr = principals(spark, d, "ns_pattern", "allowed_namespaces")
    rec = (FX.kube_events(spark, d).select(F.lit("event").alias("type"), "namespace")
           .unionByName(FX.container_logs(spark, d).select(F.lit("log").alias("type"), "namespace"))
           .unionByName(FX.scrapes(spark, d).select(F.lit("metrics_text").alias("type"), "namespace")))
    return A.record_visibility(pr, FX.principal_capabilities(spark), rec)


# ---------------------------------------------------------------- triage

@register("error_signatures", f"""with f1 as ({O.F1}),
p as ({O.parsed_cte(f"(select * from f1 where length(raw) > 0 and (not is_journal or not {O.NOISE})) s")}),
r as (select *, coalesce(sort_ms, last_value(case when sort_ms is not null and (not is_journal or {_W}) then sort_ms end
          ignore nulls) over (partition by service, file order by seq rows between unbounded preceding and current row))
          as rank_ms from p)
select regexp_replace(line, '[0-9]+', '<n>', 'g') as signature, count(*) as n, min(rank_ms) as first_ms,
       max(rank_ms) as last_ms
from r where contains(lower(line), 'error') group by 1""")
def q_error_signatures(spark, d):
    """Recurring error lines by digit-normalised signature with first/last time."""
    l0 = drop_empty(FX.log_lines(spark, d))
    l0 = l0.filter(~F.col("is_journal") | ~is_journal_noise(F.col("raw")))
    lines = inherit_timestamp(parse_lines(l0), ["service", "file"], "seq", WIN_START_MS, WIN_END_MS,
                              window_applies=F.col("is_journal"))
    return TR.error_signatures(lines)


@register("anomaly_triage", f"""with f3 as ({O.F3}), f4 as ({O.F4}), f5 as ({O.F5}), f6 as ({O.F6}), {_TARGETS_SQL},
j as (select tgu.*, f6.http_status, f6.body, f6.error_kind, f6.error_message
      from tgu left join f6 on f6.namespace = tgu.namespace and f6.pod = tgu.name),
k as (select *, metrics_enabled and coalesce(pod_ip <> '', false) as fetched, {_OK} as ok0 from j),
m as (select namespace, name as pod, case when metrics_enabled and not fetched then false when fetched then ok0 end as ok from k),
p as ({O.parsed_cte("(select * from f5 where length(raw) > 0) s")}),
u as (select 1 as priority, namespace || '/' || obj_name as target from f4
      where reason in ('OOMKilled', 'CrashLoopBackOff', 'FailedScheduling')
      union all select 2, namespace || '/' || pod from p
      where contains(lower(line), 'panic') or contains(lower(line), 'fatal') or contains(lower(line), 'segfault')
         or contains(lower(line), 'timeout') or contains(lower(line), 'connection refused')
      union all select 3, namespace || '/' || pod from m where ok = false)
select priority, target, count(*) as n from u group by priority, target""")
def q_anomaly_triage(spark, d):
    """Priority 1 events, 2 log keywords, 3 failed scrapes, counted per target."""
    t = M.scrape_targets(all_refs(spark, d))
    met = M.classify_pod_scrapes(t, FX.scrapes(spark, d), max_body_bytes=MAX_BODY)
    logs = drop_empty(FX.container_logs(spark, d))
    # the message is a suffix of the raw line: filter raw text before parsing
    logs = TR.keyword_prefilter(logs)
    return TR.anomaly_triage(FX.kube_events(spark, d), parse_lines(logs), met)


# --------------------------------------------------------------- bundles


BUNDLE_ID = "bundle-0001"
CREATED_AT = "2024-01-31T00:00:00.000Z"
NOW_ISO = "2024-01-31T00:00:00.000Z"

SERVICE_BUNDLE_COLS = ["section", "k1", "k3", "type", "bundle_id", "service", "file", "journal", "journal_scope",
                       "ts", "line", "skipped", "reason", "error", "url", "ok", "content", "max_total_log_lines",
                       "line_limited", "matched_log_records", "returned_log_records", "diagnostic_records"]


def service_bundle_df(spark, d):
    logs = service_logs(spark, d)
    metrics = M.classify_service_scrapes(FX.registry(spark, d), FX.service_scrapes(spark, d), max_body_bytes=MAX_BODY)
    return service_bundle(spark, logs, f1_sources(spark, d), metrics, SERVICE_PARAMS, BUNDLE_ID, CREATED_AT)


def _service_bundle_sql(cols: list[str], user_scope_only: bool = False) -> str:
    scope = ("case when journal_scope = 'user' then 'user' end" if user_scope_only else "journal_scope")
    rows = f"""with {_b1_ctes()},
ss as (select f2.name as service, f6.http_status, f6.body, f6.error_kind, f6.error_message from f2
       join f6 on f6.namespace = 'ns-' || cast(f2.service_idx % 5 as varchar) and f6.pod = 'pod-' || cast(f2.service_idx as varchar)),
mj as (select f2.service_idx, f2.name, f2.metrics, ss.* exclude (service) from f2 left join ss on ss.service = f2.name),
tot as (select count(*) as n_sources, coalesce(sum(matched_log_records), 0) as m,
               coalesce(sum(returned_log_records), 0) as r from summ),
b as (
  select 0 as section, cast(null as bigint) as k1, cast(null as bigint) as k3, 'meta' as type, '{BUNDLE_ID}' as bundle_id,
         null::varchar as service, null::varchar as file, null::varchar as journal, null::varchar as journal_scope,
         null::varchar as ts, null::varchar as line, null::boolean as skipped, null::varchar as reason,
         null::varchar as error, null::varchar as url, null::boolean as ok, null::varchar as content,
         null::bigint as max_total_log_lines, null::boolean as line_limited, null::bigint as matched_log_records,
         null::bigint as returned_log_records, null::bigint as diagnostic_records
  union all
  select 1, null, null, d.type, null, d.service, case when not s.is_journal then d.file end,
         case when s.is_journal then d.file end, case when s.is_journal then s.journal_scope end,
         d.ts, d.line, d.skipped, d.reason, d.error, null, null, null, null, null, null, null, null
  from diag d join src s on s.service = d.service and s.file = d.file
  union all
  select 2, sel.rank_ms, sel.seq, 'log', null, sel.service, case when not sel.is_journal then sel.file end,
         case when sel.is_journal then sel.file end, case when sel.is_journal then s.journal_scope end,
         sel.ts, sel.line, null, null, null, null, null, null, null, null, null, null, null
  from sel join src s on s.service = sel.service and s.file = sel.file
  union all
  select 3, null, null, 'log_summary', null, null, null, null, null, '{NOW_ISO}', null, null, null, null, null, null,
         null, {TOP_K}, m > r, cast(m as bigint), cast(r as bigint), (select count(*) from diag)
  from tot where n_sources > 0
  union all
  select 4, null, null, 'metrics_text', null, name, null, null, null, '{NOW_ISO}', null,
         case when metrics is null then true end, case when metrics is null then 'no_metrics_url' end, 
         case when metrics is not null then {_SERR} end, metrics,
         case when metrics is not null then {_SOK} end,
         case when metrics is not null and {_SOK} then coalesce(body, '') end, null, null, null, null, null
  from mj)
select {', '.join(c if c != 'journal_scope' else scope + ' as journal_scope' for c in cols)} from b"""
    return rows.replace("with f1 as", "with f1 as", 1).replace(
        "f7 as (", f"f6 as ({O.F6}),\nf7 as (", 1)


@register("service_bundle", _service_bundle_sql(SERVICE_BUNDLE_COLS))
def q_service_bundle(spark, d):
    """The whole service bundle as flat ordered records."""
    flat = service_bundle_df(spark, d)
    # one row per record: the summary's list of sources is compared in summary_sources
    return flat.filter("part is null or part = 0").select(*SERVICE_BUNDLE_COLS)


ROUNDTRIP_COLS = [c for c in SERVICE_BUNDLE_COLS if c not in ("section", "k1", "k3")]


@register("bundle_roundtrip", _service_bundle_sql(ROUNDTRIP_COLS, user_scope_only=True))
def q_bundle_roundtrip(spark, d):
    """Write the service bundle as gzip NDJSON to the shared folder and read it back."""
    path = shared_dir(spark, "bundle")
    write_bundle(service_bundle_df(spark, d), path)
    return read_bundle(spark, path).select(*ROUNDTRIP_COLS)


@register("summary_sources", f"""with {_b1_ctes()}
select service, file, is_journal, raw_log_records, matched_log_records, returned_log_records, skipped, reason, error,
       cast(row_number() over (order by service, is_journal, file) - 1 as integer) as place from summ""")
def q_summary_sources(spark, d):
    """The summary record's list of sources, written as items of one record and read back in order."""
    path = shared_dir(spark, "bundle")
    write_bundle(service_bundle_df(spark, d), path)
    rec = read_bundle(spark, path).filter("type = 'log_summary'").select(F.posexplode("sources").alias("place", "s"))
    return rec.select("s.service", F.coalesce("s.file", "s.journal").alias("file"), F.col("s.journal").isNotNull().alias("is_journal"),
                      "s.raw_log_records", "s.matched_log_records", "s.returned_log_records", "s.skipped", "s.reason", "s.error", "place")


@register("bundle_order", f"""with {_b1_ctes()}
select row_number() over (order by rank_ms nulls first, service, is_journal, file, seq) + (select count(*) from diag) as record_no,
       service, file, line from sel""")
def q_bundle_order(spark, d):
    """The places that a written bundle's log lines have when it is read back."""
    path = shared_dir(spark, "bundle")
    write_bundle(service_bundle_df(spark, d), path)
    rec = read_bundle(spark, path).filter("type = 'log' and skipped is null and (ts is null or ts <> '--')")
    return rec.select("record_no", "service", F.coalesce("file", "journal").alias("file"), "line")


# The catalogue bundles every selected pod of the whole tables, so the
# line budget (G3) and the window width are raised (callers may raise the
# hard maxima); the guard itself is exercised by unit tests.
POD_BUNDLE_PARAMS = ContainerLogParams(
    now_ms=NOW_MS, tail_lines=40, previous=True, exclude=("purchase",),
    window=TimeWindow(start="1996-01-01T00:00:00Z", end="2024-01-20T00:00:00Z", max_seconds=40 * 366 * 86_400),
    max_total_log_lines=1 << 62, hard_max_total_log_lines=1 << 62)
PB_START_MS, PB_END_MS = POD_BUNDLE_PARAMS.window_ms()
POD_BUNDLE_COLS = ["section", "k3", "type", "namespace", "pod", "container", "previous", "ts", "line", "skipped",
                   "reason", "error", "message", "involved_kind", "involved_name", "involved_namespace", "pod_ip",
                   "port", "path", "ok", "content"]


_POD_BUNDLE_CHAIN = f"""with f3 as ({O.F3}), f4 as ({O.F4}), f5 as ({O.F5}), f6 as ({O.F6}),
sel as (select * from f3 where label_app = 'building'),
pc as ({_PC_SQL.format(src='sel')}),
w as (select f5.* from f5 join pc using (namespace, pod, container)),
t as (select * from (select *, row_number() over (partition by namespace, pod, container, previous order by pos desc) as rn
                     from w) x where rn <= {POD_BUNDLE_PARAMS.tail_lines}),
p as ({O.parsed_cte("(select * from t where length(raw) > 0) s")}),
lg as (select * from p where sort_ms between {PB_START_MS} and {PB_END_MS} and not {O.any_contains('raw', POD_BUNDLE_PARAMS.exclude)}),
prev as (select distinct namespace, pod, container from f5 where previous),
sk as (select * from pc where not exists (select 1 from prev where prev.namespace = pc.namespace and prev.pod = pc.pod
                                           and prev.container = pc.container)),
ev as (select *, nullif(coalesce(last_timestamp, event_time, creation_timestamp), '') as ts from f4),
ev2 as (select *, epoch_ms(try_cast(replace(ts, 'Z', '') as timestamp)) as ms from ev),
evs as (select * from ev2 where ms is not null and ms >= {PB_START_MS} and ms <= {PB_END_MS} and obj_kind = 'Pod'
        and length(obj_name) > 0 and exists (select 1 from sel where sel.namespace = ev2.namespace and sel.name = ev2.obj_name
              and (nullif(sel.uid, '') is null or nullif(ev2.obj_uid, '') is null or sel.uid = ev2.obj_uid))),
{_TARGETS_SQL.replace('from f3', 'from sel')},
j as (select tgu.*, f6.http_status, f6.body, f6.error_kind, f6.error_message
      from tgu left join f6 on f6.namespace = tgu.namespace and f6.pod = tgu.name),
k as (select *, metrics_enabled and coalesce(pod_ip <> '', false) as fetched, {_OK} as ok0, {_ERR} as err0 from j),
b as (
  select 0 as section, cast(null as bigint) as k3, 'meta' as type, null::varchar as namespace, null::varchar as pod,
         null::varchar as container, null::boolean as previous, null::varchar as ts, null::varchar as line,
         null::boolean as skipped, null::varchar as reason, null::varchar as error, null::varchar as message,
         null::varchar as involved_kind, null::varchar as involved_name, null::varchar as involved_namespace,
         null::varchar as pod_ip, null::bigint as port, null::varchar as path, null::boolean as ok, null::varchar as content
  union all
  select 1, pos, 'log', namespace, pod, container, case when previous then true end, ts, line, null, null, null, null,
         null, null, null, null, null, null, null, null from lg
  union all
  select 1, -1, 'log', namespace, pod, container, true, '{NOW_ISO}', null, true, '{C.NO_PREVIOUS_CONTAINER}', null, null,
         null, null, null, null, null, null, null, null from sk
  union all
  select 2, event_id, 'event', namespace, null, null, null, ts, null, null, reason, null, message, obj_kind, obj_name,
         namespace, null, null, null, null, null from evs
  union all
  select case when metrics_enabled then 4 else 3 end, null, 'metrics_text', namespace, name, null, null, '{NOW_ISO}', null,
         case when not metrics_enabled then true end, case when not metrics_enabled then 'annotation_missing' end,
         case when metrics_enabled and not fetched then 'podIP_missing' when fetched then err0 end, null, null, null, null,
         case when fetched then pod_ip end, case when fetched then port end, case when fetched then path end,
         case when metrics_enabled and not fetched then false when fetched then ok0 end,
         case when fetched and ok0 then coalesce(body, '') end
  from k)"""


@register("pod_bundle", _POD_BUNDLE_CHAIN + "\nselect * from b")
def q_pod_bundle(spark, d):
    """The whole pod bundle (logs, previous skips, events, metrics) as flat ordered records."""
    return pod_bundle_df(spark, d).select(*POD_BUNDLE_COLS)


@register("describe_services", f"""with f1 as ({O.F1}), f2 as ({O.F2}), {_FILES_CTE}
select f2.service_idx, f2.name, array_to_string(coalesce(files.logs, []), ',') as logs, journal, journal_scope,
       cast(null as varchar) as journal_user, metrics
from f2 left join files using (name)""")
def q_describe_services(spark, d):
    """Admin registry listing (logs default [], journal/metrics default null)."""
    out = INV.describe_services(FX.registry(spark, d), admin=True)
    return out.withColumn("logs", F.array_join("logs", ","))


@register("discover_pods", f"""with f3 as ({O.F3})
select namespace, name, label_app, 'main' as containers, ready from f3
where namespace = 'ns-2' and label_tier = 'backend' and contains(name, '4')""")
def q_discover_pods(spark, d):
    """S4, P11-P13, P15 (lifecycle 3.3): non-admin pod discovery with scope, selector and name filter."""
    p = discover_pods(pod_objects(spark, d), admin=False, namespace="ns-2", selector="tier=backend", needle="4")
    return p.select("namespace", "name", F.col("labels")["app"].alias("label_app"),
                    F.array_join("containers", ",").alias("containers"), "ready")


CAP = 20


def _cap_report(df, cap: int):
    """Whole-table form of the cap guard: every selected row is counted
    (the request path stops early with ``inventory.cap_check``)."""
    n = F.count(F.lit(1))
    return df.agg(n.alias("n_selected")).select(
        "n_selected", F.lit(cap).cast("long").alias("cap"), (F.col("n_selected") > cap).alias("exceeded"))


@register("pod_cap", f"""with f3 as ({O.F3})
select count(*) as n_selected, cast({CAP} as bigint) as cap, count(*) > {CAP} as exceeded
from f3 where label_app = 'building'""")
def q_pod_cap(spark, d):
    """Selected pods against maxPods."""
    sel = INV.pods_by_selector(pod_objects(spark, d), "*", EVENT_SELECTOR)
    return _cap_report(sel, CAP)


@register("metrics_cap", f"""with f3 as ({O.F3}), {_TARGETS_SQL}
select count(*) as n_selected, cast({CAP} as bigint) as cap, count(*) > {CAP} as exceeded
from tgu where metrics_enabled and label_app = 'building'""")
def q_metrics_cap(spark, d):
    """Annotated (scrape-enabled) pods against maxMetricsPods."""
    refs = INV.pod_refs(INV.pods_by_selector(pod_objects(spark, d), "*", EVENT_SELECTOR))
    return _cap_report(M.scrape_targets(refs).filter("metrics_enabled"), CAP)


def pod_bundle_df(spark, d):
    return pod_bundle(spark, FX.pod_objects(spark, d), FX.container_logs(spark, d), FX.kube_events(spark, d),
                      FX.scrapes(spark, d), POD_BUNDLE_PARAMS, BUNDLE_ID, CREATED_AT, namespace="*",
                      selector=EVENT_SELECTOR, max_body_bytes=MAX_BODY)


@register("bundle_triage", _POD_BUNDLE_CHAIN + """,
u as (select 1 as priority, namespace || '/' || involved_name as target from b
      where type = 'event' and reason in ('OOMKilled', 'CrashLoopBackOff', 'FailedScheduling')
      union all select 2, namespace || '/' || pod from b
      where type = 'log' and (contains(lower(line), 'panic') or contains(lower(line), 'fatal')
         or contains(lower(line), 'segfault') or contains(lower(line), 'timeout')
         or contains(lower(line), 'connection refused'))
      union all select 3, namespace || '/' || pod from b where type = 'metrics_text' and ok = false)
select priority, target, count(*) as n from u group by priority, target""")
def q_bundle_triage(spark, d):
    """Write the pod bundle, read it back and triage its records."""
    path = shared_dir(spark, "pod-bundle")
    write_bundle(pod_bundle_df(spark, d), path)
    rec = read_bundle(spark, path)
    events = rec.filter(F.col("type") == "event").select("namespace", F.col("involved_name").alias("obj_name"),
                                                         "reason")
    logs = rec.filter((F.col("type") == "log") & F.col("line").isNotNull()).select("namespace", "pod", "line")
    metrics = rec.filter(F.col("type") == "metrics_text").select("namespace", "pod", "ok")
    return TR.anomaly_triage(events, logs, metrics)


@register("bundle_signatures", f"""with {_b1_ctes()},
bl as (select line, ts from sel)
select regexp_replace(line, '[0-9]+', '<n>', 'g') as signature, count(*) as n,
       min(epoch_ms(try_cast(replace(ts, 'Z', '') as timestamp))) as first_ms,
       max(epoch_ms(try_cast(replace(ts, 'Z', '') as timestamp))) as last_ms
from bl where contains(lower(line), 'error') group by 1""")
def q_bundle_signatures(spark, d):
    """Error signatures over the log records of a service
    bundle written and read back (times from the records' own ts)."""
    path = shared_dir(spark, "svc-bundle")
    write_bundle(service_bundle_df(spark, d), path)
    rec = read_bundle(spark, path).filter((F.col("type") == "log") & F.col("line").isNotNull())
    rec = rec.withColumn("ts_ms", F.unix_millis(F.try_to_timestamp(F.col("ts"))))
    return TR.error_signatures(rec, time_col="ts_ms")


# ------------------------------------------- checks and rules over derived tables

@register("tail_null_keys", """with l as (
  select event_id as seq, case when user_id % 3 > 0 then 's' || cast(user_id % 3 as varchar) end as source from events)
select source, seq from (select *, row_number() over (partition by source order by seq desc) as rn from l) x where rn <= 40""")
def q_tail_null_keys(spark, d):
    """The tail of sources of which one, with a third of the lines, has no name."""
    m = F.col("user_id") % 3
    lines = FX.table(spark, d, "events").select(
        F.col("event_id").alias("seq"), F.when(m > 0, F.concat(F.lit("s"), m.cast("string"))).alias("source"))
    return tail_per_source(lines, ["source"], "seq", 40).select("source", "seq")


@register("newest_lines_ordered", f"""with {_b1_ctes()}
select cast(row_number() over (order by rank_ms nulls first, service, is_journal, file, seq) as integer) as place,
       service, file, seq from sel""")
def q_newest_lines_ordered(spark, d):
    """K2: the place of every selected line in the bundle."""
    sel = service_logs(spark, d).newest
    return final_order(sel, "rank_ms", ["service", "is_journal", "file", "seq"], position="place").select(
        "place", "service", "file", "seq")


@register("normalize_principals", """with claims as (
  select 'c' || cast(c_custkey as varchar) as sub, case c_custkey % 4 when 1 then true when 2 then false end as adm,
         case when c_custkey % 3 <> 0 then 'ns-' || cast(c_nationkey as varchar) || ',x' end as ns,
         case when c_custkey % 6 = 0 and c_custkey % 12 <> 0 then 'logs' end as caps from customer)
select sub, case when adm is null and ns is null and caps is null then true else coalesce(adm, false) end as admin,
       coalesce(ns, '') as namespaces, coalesce(caps, '') as capabilities from claims""")
def q_normalize_principals(spark, d):
    """Claims of every customer -> principal; no claim at all means admin."""
    k = F.col("c_custkey")
    texts = "array<string>"
    claims = FX.table(spark, d, "customer").select(
        F.concat(F.lit("c"), k.cast("string")).alias("sub"),
        F.when(k % 4 == 1, True).when(k % 4 == 2, False).alias("admin"),
        F.when(k % 3 != 0, F.array(F.concat(F.lit(" ns-"), F.col("c_nationkey").cast("string"), F.lit("\t")), F.lit(" "),
                                   F.lit(None).cast("string"), F.lit("x"))).alias("allowed_namespaces"),
        F.lit(None).cast(texts).alias("allowed_services"),
        F.when((k % 6 == 0) & (k % 12 != 0), F.array(F.lit("logs "), F.lit(""))).alias("capabilities"))
    pr = A.normalize_principals(claims)
    return pr.select("sub", "admin", F.array_join("allowed_namespaces", ",").alias("namespaces"),
                     F.array_join("capabilities", ",").alias("capabilities"))


@register("journal_user_errors", """select 's' || cast(c_custkey as varchar) as service, 'EINVAL' as code,
       case c_custkey % 7 when 0 then 'journalUser is required for user journal scope'
            when 1 then 'journalUser must be a non-empty username or UID'
            when 2 then 'journalUser "4294967296" is outside the valid UID range'
            when 3 then 'journalUser "-5" must be a non-negative UID or existing username'
            else 'journalUser "-x" must be a non-negative UID or existing username' end as message
from customer where c_custkey % 2 = 0 and c_custkey % 7 <= 4""")
def q_journal_user_errors(spark, d):
    """User journals whose user cannot be used (EINVAL)."""
    k = F.col("c_custkey")
    user = (F.when(k % 7 == 1, " ").when(k % 7 == 2, "4294967296").when(k % 7 == 3, "-5").when(k % 7 == 4, "-x")
            .when(k % 7 == 5, "1000").when(k % 7 == 6, "deploy"))
    sources = FX.table(spark, d, "customer").select(
        F.concat(F.lit("s"), k.cast("string")).alias("service"), F.lit(True).alias("is_journal"),
        F.when(k % 2 == 0, "user").otherwise("system").alias("journal_scope"), user.alias("journal_user"))
    return journal_user_errors(sources, ["service"]).select("service", "code", "message")


@register("log_fetch_errors", """with e as (
  select event_id, event_id % 2 = 0 as previous, case event_id % 5 when 0 then 400 when 1 then 404 when 2 then 500 when 3 then 200 end as status,
         case event_id % 3 when 0 then 'Previous terminated container "app" not found' when 1 then 'connection reset' end as message from events),
c as (select event_id, previous and (coalesce(status, 0) in (400, 404)
             or coalesce(lower(message), '') like '%previous terminated container%') as skipped from e)
select event_id, skipped, case when skipped then 'no_previous_container' end as reason, not skipped as fatal from c""")
def q_log_fetch_errors(spark, d):
    """Failed log reads: no previous container (skip) or fatal."""
    e = F.col("event_id")
    status = F.when(e % 5 == 0, 400).when(e % 5 == 1, 404).when(e % 5 == 2, 500).when(e % 5 == 3, 200)
    message = F.when(e % 3 == 0, 'Previous terminated container "app" not found').when(e % 3 == 1, "connection reset")
    errors = FX.table(spark, d, "events").select("event_id", (e % 2 == 0).alias("previous"), status.alias("status"),
                                                 message.alias("message"))
    return C.classify_log_fetch_errors(errors).select("event_id", "skipped", "reason", "fatal")


# the rule that entry k breaks, by k % 11; entry 5 breaks two
_BROKEN_RULES = {1: "name is required", 2: "logs items must be non-empty strings", 3: "journal must be a non-empty string",
                 4: 'journalScope must be "system" or "user"', 5: "journalUser must be a non-empty string or integer UID",
                 6: "journal is required when journalScope is set", 7: "journalUser is required when journalScope is user",
                 8: "journalUser requires journalScope to be user", 9: "metrics must be a non-empty string"}


@register("registry_all_rules", "with k as (select c_custkey as k from customer)\n" + "\nunion all ".join(
    [f"select cast(k as integer) as service_idx, '{rule}' as rule from k where k % 11 = {n}" for n, rule in _BROKEN_RULES.items()]
    + ["select cast(k as integer), 'journalUser is required when journalScope is user' from k where k % 11 = 5",
       "select cast(k as integer), 'duplicate service name' from k where k % 11 = 10 and k > (select min(k) from k where k % 11 = 10)"]))
def q_registry_all_rules(spark, d):
    """A registry that breaks all ten rules, written as JSON documents of bounded size to the shared folder and read back."""
    k = F.col("c_custkey")
    m = k % 11
    entry = FX.table(spark, d, "customer").select(
        k.cast("int").alias("at"), F.struct(
            F.when(m == 1, "  ").when(m == 10, "twice").otherwise(F.concat(F.lit("svc-"), k.cast("string"))).alias("name"),
            F.when(m == 2, F.array(F.lit("/var/log/a.log"), F.lit(" "))).alias("logs"),
            F.when(m == 3, " ").when(m.isin(4, 5, 7, 8), "unit.service").alias("journal"),
            F.when(m == 4, "root").when(m.isin(5, 7), "user").when(m == 6, "system").alias("journalScope"),
            F.when(m == 5, " ").when(m == 8, "1000").alias("journalUser"),
            F.when(m == 9, "").alias("metrics")).alias("e"))
    path = shared_dir(spark, "registry")
    _registry_documents(entry).write.parquet(path)
    found = parse_services(spark.read.parquet(path), "ats")
    numbered = found.withColumn("service_idx", F.element_at("ats", F.col("service_idx") + 1)).drop("ats")
    return INV.registry_violations(numbered).select("service_idx", "rule")


def _registry_documents(entry, size=1000):
    """JSON arrays (value) of the entries (at, e) by runs of ``size`` numbers, with the entries' numbers (ats)."""
    rows = F.array_sort(F.collect_list(F.struct("at", "e")))
    docs = entry.groupBy(F.floor(F.col("at") / size).alias("run")).agg(rows.alias("rows"))
    return docs.select(F.col("rows.at").alias("ats"), F.to_json("rows.e").alias("value"))


@register("scrape_outcomes", f"""with f6 as ({O.F6})
select namespace, http_status, error_kind, count(*) as n_pods, cast(sum(length(body)) as bigint) as body_chars
from f6 group by namespace, http_status, error_kind""")
def q_scrape_outcomes(spark, d):
    """Scrape outcomes written as JSON lines to the shared folder and read back."""
    path = shared_dir(spark, "scrapes")
    FX.scrapes(spark, d).write.json(path)
    got = read_scrapes(spark, path, fmt="json")
    return got.groupBy("namespace", "http_status", "error_kind").agg(
        F.count(F.lit(1)).alias("n_pods"), F.sum(F.length("body")).alias("body_chars"))


# ------------------------------------------- readers: written as the API's documents and read back

PAGE_ITEMS = 2000


def _write_pages(rows, number, item, path):
    """List documents (items[] of PAGE_ITEMS numbers each) as one JSON file per page.  ``rows`` have ``number`` and ``item``."""
    page = F.floor(F.col(number) / PAGE_ITEMS)
    # at most PAGE_ITEMS items a page
    docs = rows.groupBy(page.alias("page")).agg(F.array_sort(F.collect_list(F.struct(number, F.to_json(item).alias("json")))).alias("items"))
    text = F.concat(F.lit('{"kind":"List","items":['), F.array_join("items.json", ","), F.lit('],"metadata":{"continue":"'), F.col("page").cast("string"), F.lit('"}}'))
    docs.select(text.alias("value")).write.option("maxRecordsPerFile", 1).text(path)


@register("pod_pages", f"""with k as (select c_custkey, c_custkey // {PAGE_ITEMS} as page,
  row_number() over (partition by c_custkey // {PAGE_ITEMS} order by c_custkey) - 1 as item from customer),
f3 as ({O.F3})
select k.item, f3.namespace, f3.name, f3.label_app, 'main' as containers, f3.ready
from f3 join k on f3.name = 'pod-' || cast(k.c_custkey as varchar) where f3.label_tier = 'backend'""")
def q_pod_pages(spark, d):
    """Pods written as list documents, each read back in ranges by several tasks, then listed."""
    objects = pod_objects(spark, d).withColumn("number", F.substring_index("metadata.name", "-", -1).cast("long"))
    path = shared_dir(spark, "pod-pages")
    _write_pages(objects.select("number", F.struct("metadata", "spec", "status").alias("item")), "number", "item", path)
    pods = read_pods(spark, path, split_bytes=1 << 16)
    p = INV.describe_pods(INV.pods_by_selector(pods, "*", "tier=backend"), admin=False, keep=("item",))
    return p.select("item", "namespace", "name", F.col("labels")["app"].alias("label_app"),
                    F.array_join("containers", ",").alias("containers"), "ready")


@register("event_pages", f"""with f4 as ({O.F4})
select namespace, last_timestamp, event_time, creation_timestamp, reason, message, obj_kind, obj_name, obj_uid
from f4 where namespace in ('ns-1', 'ns-3')""")
def q_event_pages(spark, d):
    """Events written as list documents and read back in ranges, of the selected namespaces."""
    e = FX.kube_events(spark, d)
    none = F.lit(None).cast("string")
    item = F.struct(F.struct(F.col("creation_timestamp").alias("creationTimestamp"), "namespace").alias("metadata"),
                    F.col("last_timestamp").alias("lastTimestamp"), F.col("event_time").alias("eventTime"), "reason", "message",
                    F.struct(F.col("obj_kind").alias("kind"), F.col("obj_name").alias("name"), none.alias("namespace"),
                             F.col("obj_uid").alias("uid")).alias("involvedObject"))
    path = shared_dir(spark, "event-pages")
    _write_pages(e.select(F.col("event_id").alias("number"), item.alias("item")), "number", "item", path)
    return read_events(spark, path, ["ns-1", "ns-3"], split_bytes=1 << 16).select(
        "namespace", "last_timestamp", "event_time", "creation_timestamp", "reason", "message", "obj_kind", "obj_name", "obj_uid")


BLOB_LINES = 30


@register("container_log_blobs", f"""with f5 as ({O.F5}),
t as (select *, row_number() over (partition by namespace, pod, container, previous order by pos desc) as rn from f5),
k as (select * from t where rn <= {BLOB_LINES})
select namespace, pod, container, previous, raw,
       cast(row_number() over (partition by namespace, pod, container, previous order by pos) - 1 as integer) as pos from k""")
def q_container_log_blobs(spark, d):
    """S3: what one log request returns, the text of a container's last lines, split into lines again."""
    keys = ["namespace", "pod", "container", "previous"]
    last = tail_per_source(FX.container_logs(spark, d), keys, "pos", BLOB_LINES)
    # at most BLOB_LINES lines a container
    blobs = last.groupBy(*keys).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "raw"))), lambda x: x["raw"]), "\n").alias("text"))
    path = shared_dir(spark, "log-blobs")
    blobs.write.json(path)
    schema = "namespace string, pod string, container string, previous boolean, text string"
    return read_container_logs(spark.read.schema(schema).json(path)).select(*keys, "raw", "pos")


@register("unidentified_pods", """with c as (select c_custkey as k, c_custkey % 3 as a, c_custkey % 5 as b from customer)
select coalesce(case when a <> 1 then 'ns' end, '') as namespace, coalesce(case when b = 1 then '' when b <> 2 then 'pod-' || cast(k as varchar) end, '') as name,
       'uid-' || cast(k as varchar) as uid from c where a = 1 or b in (1, 2)""")
def q_unidentified_pods(spark, d):
    """A4: pod objects without namespace or name."""
    k = F.col("c_custkey")
    bare = FX.table(spark, d, "customer").select(
        F.when(k % 3 != 1, "ns").alias("_ns"),
        F.when(k % 5 == 1, "").when(k % 5 != 2, F.concat(F.lit("pod-"), k.cast("string"))).alias("_name"), F.concat(F.lit("uid-"), k.cast("string")).alias("_uid"),
        F.concat(F.lit("pod-"), k.cast("string")).alias("_key"))
    objects = pod_objects(spark, d).join(bare, F.col("metadata.name") == F.col("_key")).withColumn(
        "metadata", F.col("metadata").withField("namespace", F.col("_ns")).withField("name", F.col("_name")).withField("uid", F.col("_uid")))
    return INV.unidentified_pods(INV.pod_refs(objects)).select("namespace", "name", "uid")


@register("windows_without_journal", """select 'r' || cast(user_id as varchar) as request from events
group by user_id having max(case when event_id % 16 = user_id % 16 and event_type = 'error' then 1 else 0 end) = 0""")
def q_windows_without_journal(spark, d):
    """Requests with a time window whose sources are all files (each user's events as the sources of one request)."""
    e = FX.table(spark, d, "events")
    sources = e.select(F.concat(F.lit("r"), F.col("user_id").cast("string")).alias("request"),
                       ((F.col("event_id") % 16 == F.col("user_id") % 16) & (F.col("event_type") == "error")).alias("is_journal"))
    return without_journal(sources, ["request"]).select("request")


USER_TAIL = 9


@register("user_journal_tails", f"""with f1 as ({O.F1}),
jl as (select *, service || file as source, service in ('svc-0', 'svc-1', 'svc-3') or (service = 'svc-2' and {O.NOISE}) as has_unit from f1 where is_journal),
p as (select *, row_number() over (partition by service, source order by seq desc) as rn from jl where has_unit),
pt as (select * from p where rn <= {USER_TAIL}),
ok as (select distinct service, source from pt where not {O.NOISE}),
f as (select *, row_number() over (partition by service, source order by seq desc) as rn from jl),
ft as (select * from f where rn <= {USER_TAIL} and not exists (select 1 from ok where ok.service = f.service and ok.source = f.source))
select service, source, seq, raw, 'primary' as via from pt
where not {O.NOISE} and exists (select 1 from ok where ok.service = pt.service and ok.source = pt.source)
union all select service, source, seq, raw, 'fallback' from ft where not {O.NOISE}""")
def q_user_journal_tails(spark, d):
    """User journals read their last N entries, blank ones among them, before blanks are dropped."""
    lines = FX.log_lines(spark, d).filter("is_journal").withColumn("source", F.concat("service", "file"))
    none = F.lit(None).cast("string")
    has_unit = F.col("service").isin("svc-0", "svc-1", "svc-3") | ((F.col("service") == "svc-2") & is_journal_noise(F.col("raw")))
    table = lines.select(none.alias("unit"), F.when(has_unit, F.col("source")).alias("user_unit"), F.col("source").alias("systemd_user_unit"),
                         F.lit("1000").alias("uid"), "seq", "raw")
    sources = lines.select("service", "source", F.col("source").alias("journal"), F.lit(True).alias("is_journal"),
                           F.lit("user").alias("journal_scope"), F.lit("1000").alias("journal_user")).distinct()
    return drop_journal_noise(journal_source_lines(sources, table, tail_lines=USER_TAIL)).select("service", "source", "seq", "raw", "via")


# ------------------------------------------- message templates (G8) and scopes over many names

# Shipment messages of all line items; the words of a part's name, ids and numbers vary, some messages have an end of their own.
_MESSAGES = """select case when l_linenumber % 3 = 0 then 'error part ' || p_name || ' of lot L' || cast(l_orderkey as varchar) || ' rejected by ' || lower(p_type)
       when l_linenumber % 3 = 1 then 'error while sending ' || p_name || ' to /srv/ship/' || lower(l_returnflag) || '/' || p_brand || ' : ' || lower(p_type) || ' line'
       else 'error ' || split_part(p_name, ' ', 1) || ' queue full' end as line,
       cast(epoch_ms(l_shipdate) as bigint) as ms
from lineitem join part on p_partkey = l_partkey"""


def _messages(spark, d):
    n, flag = F.col("l_linenumber") % 3, F.lower("l_returnflag")
    line = (F.when(n == 0, F.concat(F.lit("error part "), "p_name", F.lit(" of lot L"), F.col("l_orderkey").cast("string"), F.lit(" rejected by "), F.lower("p_type")))
            .when(n == 1, F.concat(F.lit("error while sending "), "p_name", F.lit(" to /srv/ship/"), flag, F.lit("/"), "p_brand", F.lit(" : "), F.lower("p_type"), F.lit(" line")))
            .otherwise(F.concat(F.lit("error "), F.substring_index("p_name", " ", 1), F.lit(" queue full"))))
    items = FX.table(spark, d, "lineitem").join(FX.table(spark, d, "part"), F.col("p_partkey") == F.col("l_partkey"))
    return items.select(line.alias("line"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("rank_ms"))


_WIDE = TM.FAN_OUT
_LEVEL = """n{k} as (select l.*, case when c.kids > {fan} then '<*>' else coalesce(tokens[{k}], '') end as t{k} from n{j} l
  join (select {by}, count(distinct coalesce(tokens[{k}], '')) as kids from n{j} group by {by}) c using ({by}))"""


@register("line_templates", f"""with m as ({_MESSAGES}),
w as (select list_transform(list_filter(regexp_split_to_array(line, '\\s+'), lambda t: t <> ''),
             lambda t: case when regexp_matches(t, '[0-9]') then '<*>' else t end) as tokens, ms from m),
n0 as (select tokens, count(*) as n, min(ms) as lo, max(ms) as hi, len(tokens) as size from w group by tokens),
{_LEVEL.format(k=1, j=0, by='size', fan=_WIDE)},
{_LEVEL.format(k=2, j=1, by='size, t1', fan=_WIDE)},
{_LEVEL.format(k=3, j=2, by='size, t1, t2', fan=_WIDE)},
leaf as (select size, t1, t2, t3, cast(sum(n) as bigint) as n, count(*) as n_distinct, min(lo) as first_ms, max(hi) as last_ms from n3 group by all),
u as (select size, t1, t2, t3, unnest(range(4, size + 1)) as p, unnest(tokens[4:]) as token from n3),
q as (select size, t1, t2, t3, p, case when min(token) = max(token) then min(token) else '<*>' end as token from u group by all),
z as (select size, t1, t2, t3, list(token order by p) as rest from q group by all)
select array_to_string(list_concat(list_filter([t1, t2, t3], lambda t: t <> ''), coalesce(rest, [])), ' ') as template, n, n_distinct, first_ms, last_ms
from leaf left join z using (size, t1, t2, t3)""")
def q_line_templates(spark, d):
    """Messages by templates whose words, ids and paths vary, from a tree of token positions."""
    return TM.line_templates(_messages(spark, d), fan_out=_WIDE)


_GLOBS = """select 'c' || cast(c_custkey % 500 as varchar) as sub,
  case c_custkey % 5 when 0 then 'svc-*' || cast(c_custkey as varchar) when 1 then '*-' || cast(c_nationkey as varchar) || '-*' || cast(c_custkey % 10 as varchar)
       when 2 then 'svc-' || cast(c_nationkey as varchar) || '-*' when 3 then '*9' || cast(c_custkey % 100 as varchar) || '*' else '*' || cast(c_custkey % 1000 as varchar) end as pattern
  from customer"""


@register("glob_matches", f"""with g as ({_GLOBS}),
s as (select distinct 'svc-' || cast(o_custkey % 25 as varchar) || '-' || cast(o_orderkey as varchar) as name from orders),
p as (select distinct pattern from g)
select pattern, count(*) as n_names, min(name) as first_name, max(name) as last_name
from p join s on {_glob_sql('s.name', 'p.pattern')} group by pattern""")
def q_glob_matches(spark, d):
    """Thousands of patterns, most of which open alike, over all services, by the gram index."""
    k, c = F.col("c_custkey"), lambda x: x.cast("string")
    pattern = (F.when(k % 5 == 0, F.concat(F.lit("svc-*"), c(k))).when(k % 5 == 1, F.concat(F.lit("*-"), c(F.col("c_nationkey")), F.lit("-*"), c(k % 10)))
               .when(k % 5 == 2, F.concat(F.lit("svc-"), c(F.col("c_nationkey")), F.lit("-*"))).when(k % 5 == 3, F.concat(F.lit("*9"), c(k % 100), F.lit("*")))
               .otherwise(F.concat(F.lit("*"), c(k % 1000))))
    patterns = FX.table(spark, d, "customer").select(pattern.alias("pattern")).distinct()
    o = FX.table(spark, d, "orders")
    names = o.select(F.concat(F.lit("svc-"), c(F.col("o_custkey") % 25), F.lit("-"), c(F.col("o_orderkey"))).alias("_name")).distinct()
    return (A.pattern_matches(patterns, names).groupBy("pattern")
            .agg(F.count(F.lit(1)).alias("n_names"), F.min("_name").alias("first_name"), F.max("_name").alias("last_name")))
