"""DuckDB oracle SQL for the query catalogue.

Independent re-statements of each catalogue query in DuckDB's dialect
over the same parquet tables (registered as views by the checker).
The fixture CTEs mirror ``obsspark.sources.fixtures``.
"""

from __future__ import annotations

# Fixed values, written out here so that a mistake in the engine's own shows.
NO_ENTRIES_SQL = r"^--[ \t]*No entries[ \t]*--$"
LINE_TIME_SQL = r"^[0-9]{4}-[0-9][0-9]-[0-9][0-9]T[0-9][0-9]:[0-9][0-9]:[0-9][0-9]([.,][0-9]+)?(Z|[-+][0-9][0-9]:?[0-9][0-9])?$"


def iso(x: str) -> str:
    return f"strftime({x}, '%Y-%m-%dT%H:%M:%S.%gZ')"


F1 = f"""select 'svc-' || cast(user_id % 8 as varchar) as service,
       '/var/log/' || event_type || '.log' as file,
       event_type in ('error', 'view') as is_journal,
       event_id as seq,
       case when event_id % 50 = 7 then ''
            when event_id % 200 = 11 then '   '
            when event_id % 200 = 9 then '-- No entries --'
            when event_id % 10 = 3 then upper(event_type) || ' user=' || cast(user_id as varchar)
            when event_id % 97 = 0 then '2024-02-30T00:00:00Z ' || event_type
            else {iso('ts')} || ' ' || event_type || ' user=' || cast(user_id as varchar) || ' ' || props
       end as raw,
       ts as entry_ts
from events"""

F2 = """select distinct cast(user_id % 8 as int) as service_idx,
       'svc-' || cast(user_id % 8 as varchar) as name,
       case when user_id % 8 in (1, 3, 5) then 'unit-' || cast(user_id % 8 as varchar) || '.service' end as journal,
       case when user_id % 8 = 5 then 'user' when user_id % 8 in (1, 3) then 'system' end as journal_scope,
       case when user_id % 8 <> 2 then 'http://10.0.0.' || cast(user_id % 8 as varchar) || ':9090/metrics' end as metrics
from events"""

F3 = """select 'ns-' || cast(c_custkey % 5 as varchar) as namespace,
       'pod-' || cast(c_custkey as varchar) as name,
       case when c_custkey % 7 = 0 then null else 'uid-' || cast(c_custkey as varchar) end as uid,
       lower(c_mktsegment) as label_app,
       case when c_custkey % 2 = 0 then 'backend' else 'frontend' end as label_tier,
       case when c_custkey % 4 = 0 then null when c_custkey % 9 = 8 then 'True' else 'true' end as ann_scrape,
       case c_custkey % 6 when 0 then null when 1 then 'abc' when 2 then '-1' when 3 then '9090abc' when 4 then ' 80' else '8080' end as ann_port,
       case c_custkey % 5 when 0 then null when 1 then '/custom' when 2 then 'nope' when 3 then '/a/../b' else ' /m?x=1' end as ann_path,
       case when c_custkey % 13 = 0 then null else '10.0.0.' || cast(c_custkey % 250 as varchar) end as pod_ip,
       'main' as container, case when c_custkey % 3 = 0 then 'init' end as init_container,
       c_acctbal > 0 as ready
from customer"""

F4 = f"""select o_orderkey as event_id,
       'ns-' || cast(o_custkey % 5 as varchar) as namespace,
       case when o_orderkey % 4 = 0 then null else {iso('o_orderdate')} end as last_timestamp,
       case when o_orderkey % 8 = 0 then null else {iso('o_orderdate')} end as event_time,
       case when o_orderkey % 16 = 0 then null else {iso('o_orderdate')} end as creation_timestamp,
       case o_orderkey % 6 when 0 then 'OOMKilled' when 1 then 'CrashLoopBackOff' when 2 then 'FailedScheduling' else 'Started' end as reason,
       o_orderpriority as message,
       case when o_orderkey % 11 = 0 then 'Node' else 'Pod' end as obj_kind,
       'pod-' || cast(o_custkey as varchar) as obj_name,
       case when o_orderkey % 3 = 0 then null when o_orderkey % 5 = 0 then 'uid-stale' else 'uid-' || cast(o_custkey as varchar) end as obj_uid
from orders"""

F5 = f"""select 'ns-' || cast(user_id % 5 as varchar) as namespace,
       'pod-' || cast(user_id as varchar) as pod,
       'main' as container,
       event_id % 5 = 0 and user_id % 2 = 0 as previous,
       event_id as pos,
       case when event_id % 10 = 3 then event_type || ' no timestamp' else {iso('ts')} || ' ' || event_type || ' ' || props end as raw
from events"""

F6 = """select 'ns-' || cast(c_custkey % 5 as varchar) as namespace,
       'pod-' || cast(c_custkey as varchar) as pod,
       case c_custkey % 10 when 0 then 503 when 1 then 404 when 2 then null when 3 then null when 4 then 204 else 200 end as http_status,
       case c_custkey % 10 when 2 then 'timeout' when 3 then 'connect' end as error_kind,
       case when c_custkey % 10 = 3 then 'ECONNREFUSED' end as error_message,
       case when c_custkey % 10 in (2, 3) then null else 'metric_a ' || cast(c_custkey as varchar) end as body
from customer"""

F7 = """select distinct 'svc-' || cast(user_id % 8 as varchar) as service,
       '/var/log/' || event_type || '.log' as file,
       case when event_type = 'click' then 'ENOENT' when event_type = 'view' then 'EACCES' else 'EOTHER' end as code,
       case when event_type = 'error' then 'Permission denied' else '' end as stderr,
       'read failed' as message
from events
where user_id % 8 in (2, 6) and event_type in ('click', 'view', 'error')"""

F8 = """select * from (values
  ('root',   true,  cast(null as varchar), cast(null as varchar)),
  ('all',    false, 'ns-*', 'svc-*'),
  ('narrow', false, 'ns-1', 'svc-*3'),
  ('mid',    false, '*-2',  'svc-1'),
  ('star',   false, '*',    '*'),
  ('none',   false, 'prod-*', 'x*y')
) as t(sub, admin, ns_pattern, svc_pattern)"""

F8_CAPS = """select * from (values
  ('all', 'pods'), ('all', 'logs'), ('all', 'events'), ('all', 'metrics'),
  ('narrow', 'logs'),
  ('mid', 'events'), ('mid', 'metrics'),
  ('star', 'pods'), ('star', 'logs')
) as t(sub, capability)"""


def ms_of(tok: str) -> str:
    """Epoch ms of a timestamp token, NULL when invalid (fixtures use 'Z' only)."""
    return (f"case when regexp_matches({tok}, '{LINE_TIME_SQL}') then "
            f"epoch_ms(try_cast(replace(replace({tok}, ',', '.'), 'Z', '') as timestamp)) end")


def tok_of(raw: str) -> str:
    return f"case when strpos({raw}, ' ') > 1 then split_part({raw}, ' ', 1) end"


WS_SQL = "(' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"


def dtrim(x: str) -> str:
    return f"trim({x}, {WS_SQL})"


NOISE = f"({dtrim('raw')} = '' or regexp_matches({dtrim('raw')}, '{NO_ENTRIES_SQL}'))"


def parsed_cte(src: str, timestamps: bool = True) -> str:
    """Adds ts, line, sort_ms to every row of ``src`` (which has ``raw``)."""
    if not timestamps:
        return (f"select *, cast(null as varchar) as ts, raw as line, cast(null as bigint) as sort_ms "
                f"from {src}")
    return f"""select *, case when sort_ms is not null then tok end as ts,
       case when sort_ms is not null then substr(raw, strpos(raw, ' ') + 1) else raw end as line
from (select *, {ms_of('tok')} as sort_ms
      from (select *, {tok_of('raw')} as tok from {src}) t0) t1"""


def any_contains(col: str, pats) -> str:
    if not pats:
        return "true"
    return "(" + " or ".join(f"contains({col}, '{p.replace(chr(39), chr(39) * 2)}')" for p in pats) + ")"


PERMISSION_HINT = "(?i)not seeing messages from other users|permission denied"


def error_reason(is_journal="is_journal", code="code", stderr="stderr") -> str:
    eff = (f"(case when regexp_matches(coalesce({stderr}, ''), '{PERMISSION_HINT}') then 'EACCES' "
           f"else {code} end)")
    return (f"(case when {is_journal} then (case {eff} when 'ENOENT' then 'journalctl_not_found' "
            f"when 'EACCES' then 'journal_permission_denied' when 'ENOUSER' then 'journal_user_not_found' "
            f"when 'EINVAL' then 'journal_user_invalid' else 'journal_read_error' end) "
            f"else (case when {code} = 'ENOENT' then 'file_not_found' else 'read_error' end) end)")


def error_text(user_permission_text: str, is_journal="is_journal", scope="journal_scope", reason="reason",
               stderr="stderr", message="message") -> str:
    ts = dtrim(stderr)
    hinted = f"regexp_matches(coalesce({stderr}, ''), '{PERMISSION_HINT}')"
    fallback = f"coalesce(nullif({ts}, ''), case when {dtrim(message)} <> '' then {message} end, 'unknown error')"
    return (f"(case when not {is_journal} then {message} "
            f"when coalesce({scope}, 'system') = 'user' then (case {reason} "
            f"when 'journal_permission_denied' then '{user_permission_text}' "
            f"when 'journalctl_not_found' then 'journalctl not found' else {fallback} end) "
            f"when {hinted} then {ts} else coalesce(nullif({ts}, ''), {message}) end)")


def service_logs_ctes(tail: int, start_ms, end_ms, include, exclude, top_k: int,
                      user_permission_text: str, now_iso: str, entry_filter: str | None = None) -> str:
    """CTE chain of B1 on F1/F2/F7: src, got (delivered lines with
    rank_ms/matched), sel (top-K), diag (side records), summ (G1)."""
    w = "true" if start_ms is None else f"sort_ms between {start_ms} and {end_ms}"
    entry = f" and {entry_filter}" if entry_filter else ""
    if start_ms is None:
        tailed = f"""tl as (select * from (select *, row_number() over (partition by service, file order by seq desc) as rn
                      from l0) x where rn <= {tail}),
ft as (select * from tl where not is_journal),
dl0 as (select service, file, is_journal, seq, raw from tl where not is_journal or not {NOISE})"""
    else:
        tailed = f"""ft as (select * from (select *, row_number() over (partition by service, file order by seq desc) as rn
                      from l0 where not is_journal) x where rn <= {tail}),
dl0 as (select service, file, is_journal, seq, raw from ft
        union all select service, file, is_journal, seq, raw from l0 where is_journal and not {NOISE}{entry})"""
    return f"""f1 as ({F1}),
f2 as ({F2}),
f7 as ({F7}),
src as (select s.service, s.file, s.is_journal, case when s.is_journal then r.journal_scope end as journal_scope
        from (select distinct service, file, is_journal from f1) s left join f2 r on r.name = s.service),
l0 as (select * from f1 where not exists (select 1 from f7 where f7.service = f1.service and f7.file = f1.file)),
{tailed},
blank as (select service, file from ft group by service, file
          having max(case when {dtrim('raw')} <> '' then 1 else 0 end) = 0),
dl as (select * from dl0 where length(raw) > 0
       and not exists (select 1 from blank b where b.service = dl0.service and b.file = dl0.file)),
p as ({parsed_cte('dl')}),
r as (select *, coalesce(sort_ms, last_value(case when sort_ms is not null and (not is_journal or {w}) then sort_ms end
          ignore nulls) over (partition by service, file order by seq rows between unbounded preceding and current row))
          as rank_ms from p),
got as (select *, ((not is_journal or sort_ms is null or {w}) and {any_contains('raw', include)}
                   and not {any_contains('raw', exclude)}) as matched from r),
sel as (select * from got where matched
        order by rank_ms desc nulls last, service desc, is_journal desc, file desc, seq desc limit {top_k}),
fail as (select src.service, src.file, src.is_journal, src.journal_scope, f7.code, f7.stderr, f7.message
         from src join f7 on f7.service = src.service and f7.file = src.file),
fail2 as (select *, {error_reason()} as reason from fail),
faild as (select service, file, is_journal, journal_scope, reason,
                 {error_text(user_permission_text)} as error,
                 case when is_journal and coalesce(journal_scope, 'system') = 'user' then 'log_error' else 'log' end as type,
                 case when is_journal and coalesce(journal_scope, 'system') = 'user' then null else true end as skipped
          from fail2),
cnt as (select service, file, count(*) as raw_log_records,
               sum(case when matched then 1 else 0 end) as matched_log_records from got group by service, file),
ret as (select service, file, count(*) as returned_log_records from sel group by service, file),
summ as (select src.service, src.file, src.is_journal, src.journal_scope,
                cast(coalesce(cnt.raw_log_records, 0) as bigint) as raw_log_records,
                cast(coalesce(cnt.matched_log_records, 0) as bigint) as matched_log_records,
                cast(coalesce(ret.returned_log_records, 0) as bigint) as returned_log_records,
                case when faild.service is not null then true end as skipped, faild.reason, faild.error
         from src left join cnt on cnt.service = src.service and cnt.file = src.file
                  left join ret on ret.service = src.service and ret.file = src.file
                  left join faild on faild.service = src.service and faild.file = src.file),
diag as (select service, file, type, '{now_iso}' as ts, cast(null as varchar) as line, skipped, reason, error
         from faild
         union all
         select service, file, 'log' as type, '--' as ts, 'No entries --' as line, cast(null as boolean) as skipped,
                cast(null as varchar) as reason, cast(null as varchar) as error
         from summ where is_journal and coalesce(journal_scope, 'system') = 'user' and raw_log_records = 0
              and skipped is null)"""
