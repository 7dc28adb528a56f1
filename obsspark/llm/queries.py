"""Queries of the operators and their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from obsspark.llm import bpe, fingerprints, kd_shards, language_id, mixing, prefix_trie, quality, revisits, secrets, spelling, topk
from obsspark.llm import exact_dedup as dedup
from obsspark.llm import near_dedup as near
from obsspark.llm.common import documents


def op1_kd_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = kd_shards.shard_rows(documents(spark, sf_dir), shards=16)
    return rows.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mixture(documents(spark, sf_dir))


def op3_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(documents(spark, sf_dir))


def op4_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op5_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.exact_dedup(documents(spark, sf_dir))


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.encode_documents(documents(spark, sf_dir))


def op7_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language_id.language_id(documents(spark, sf_dir))


def op8_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_duplicates(documents(spark, sf_dir)).drop("dk", "group")


def op9_warc_revisits(spark: SparkSession, sf_dir: str) -> DataFrame:
    return revisits.resolve_revisits(revisits.records(spark.read.parquet(f"{sf_dir}/pages.parquet")))


def op10_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(spark.read.parquet(f"{sf_dir}/embeddings.parquet"), F.col("vec_id") % 50 == 0)


def op11_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.weighted_fingerprints(documents(spark, sf_dir))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie.prefix_trie(spark.read.parquet(f"{sf_dir}/conversations.parquet"))


def op13_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_kd_sharding": op1_kd_sharding,
    "op2_mix_sources": op2_mix_sources,
    "op3_secret_scan": op3_secret_scan,
    "op4_quality": op4_quality,
    "op5_exact_dedup": op5_exact_dedup,
    "op6_bpe": op6_bpe,
    "op7_language_id": op7_language_id,
    "op8_minhash_near_dedup": op8_minhash_near_dedup,
    "op9_warc_revisits": op9_warc_revisits,
    "op10_exact_topk": op10_exact_topk,
    "op11_fingerprints": op11_fingerprints,
    "op12_prefix_trie": op12_prefix_trie,
    "op13_spelling_variants": op13_spelling_variants,
}

ORACLE: dict[str, str] = {}

ORACLE["op2_mix_sources"] = r"""
with d as (
  select doc_id, source, cast(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as bigint) as size,
         md5(coalesce(cast(doc_id as varchar), '') || ':' || coalesce(text, '')) as key
  from documents),
s as (
  select source, cast(sum(size) as bigint) as source_size,
         cast([3, 1, 2][1 + (row_number() over (order by source nulls last) - 1) % 3] as double) as w
  from d group by source),
f as (
  select *, cast(2 * source_size as double) as cap,
         (sum(source_size) over () * 1.5::double
          - coalesce(sum(2.0::double * source_size) over (order by 2.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0))
         / (sum(w) over () - coalesce(sum(w) over (order by 2.0::double * source_size / w, source nulls last rows between unbounded preceding and 1 preceding), 0)) as level
  from s),
l as (
  select min_by(level, cap / w) as level from f where level * w <= cap),
t as (
  select f.source, f.source_size, coalesce(least(cap, l.level * w), cap) as target,
         case when source_size > 0 then floor(coalesce(least(cap, l.level * w), cap) / source_size) else 0 end as epochs
  from f left join l on true),
r as (
  select d.doc_id, d.size, t.source_size, t.target, t.epochs, t.target - t.epochs * t.source_size as rest,
         sum(d.size) over (partition by d.source order by d.key, d.doc_id, d.size rows unbounded preceding) - d.size as before
  from d join t on d.source is not distinct from t.source)
select doc_id, size, source_size, target,
       cast(size * (epochs + case when rest > 0 and before + size / 2.0 <= rest then 1 else 0 end) as bigint) as taken
from r
"""

ORACLE["op5_exact_dedup"] = """
with g as (
  select coalesce(text, '') as t, max(doc_id) as keep_id, count(*) as group_size from documents group by 1)
select d.doc_id, g.keep_id, cast(g.group_size as bigint) as group_size, d.doc_id is not distinct from g.keep_id as kept,
       sha256(g.t) as text_sha256
from documents d join g on coalesce(d.text, '') = g.t
"""

ORACLE["op8_minhash_near_dedup"] = r"""
with recursive w as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') as words
  from documents),
s as (
  select distinct doc_id, unnest(case when len(words) >= 5
           then list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' '))
           when len(words) > 0 then [array_to_string(words, ' ')] else [] end) as shingle
  from w),
n as (select doc_id, count(*) as n from s group by doc_id),
c as (
  select a.doc_id as x, b.doc_id as y, count(*) as shared
  from s a join s b on a.shingle = b.shingle and a.doc_id <> b.doc_id group by all),
l as (
  select x, y from c join n a on a.doc_id = x join n b on b.doc_id = y where 100 * shared >= 75 * (a.n + b.n - shared)),
r as (
  select doc_id, doc_id as seen from n
  union
  select r.doc_id, l.y from r join l on l.x = r.seen)
select w.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(min(r.seen), w.doc_id) as component_id,
       coalesce(min(r.seen), w.doc_id) = w.doc_id as kept
from w left join n on n.doc_id = w.doc_id left join r on r.doc_id = w.doc_id
group by w.doc_id, n.n
"""

ORACLE["op10_exact_topk"] = """
with v as (
  select vec_id, list_transform(embedding, lambda x: cast(floor(256 * cast(x as double)) as bigint)) as v
  from embeddings
  where len(embedding) > 0 and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (
  select q.vec_id as query_id, c.vec_id,
         cast(list_sum(list_transform(range(1, len(q.v) + 1), lambda i: q.v[i] * c.v[i])) as bigint) as score
  from v q join v c on q.vec_id % 50 = 0 and c.vec_id <> q.vec_id and len(c.v) = len(q.v)),
r as (select *, cast(row_number() over (partition by query_id order by score desc, vec_id) as int) as rank from s)
select query_id, rank, vec_id, score from r where rank <= 5
"""

ORACLE["op9_warc_revisits"] = r"""
with u as (
  select page_id, md5(coalesce(html, '')) as tag, strlen(coalesce(html, '')) as bytes, regexp_replace(trim(url), '#.*$', '', 's') as bare
  from pages),
k as (
  select page_id, bytes, case when page_id % 11 <> 0 then '"' || tag || '"' end as etag,
         case when page_id % 5 <> 0 then cast(page_id - page_id % 7 as varchar) end as changed,
         regexp_replace(lower(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)', 1)), ':(80|443)$', '')
         || regexp_replace(regexp_extract(bare, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)', 1), '/+$', '') as place,
         list_sort(list_filter(string_split(regexp_extract(bare, '\?(.*)$', 1, 's'), '&'), lambda x: x <> '' and not starts_with(x, 'utm_'))) as params
  from u),
c as (select *, place || case when len(params) > 0 then '?' || array_to_string(params, '&') else '' end as canonical from k),
v as (
  select 2 * page_id + 1 as record_id, canonical, page_id + 1 + page_id % 977 as ts,
         case when page_id % 13 = 0 then '"other"' else etag end as etag, changed from c),
m as (
  select v.*, r.page_id as response, r.etag as own_etag, r.changed as own_changed, r.bytes
  from v left join c r on r.canonical = v.canonical and r.page_id < v.ts
  qualify row_number() over (partition by v.record_id order by r.page_id desc nulls last) = 1),
s as (
  select *, case when response is null then 'missing'
                 when etag is not null and own_etag is not null then case when etag = own_etag then 'resolved' else 'mismatch' end
                 when changed is not null and own_changed is not null then case when changed = own_changed then 'resolved' else 'mismatch' end
                 else 'unvalidated' end as state
  from m)
select record_id, canonical, case when state in ('resolved', 'unvalidated') then 2 * response end as response_id, state,
       case when state in ('resolved', 'unvalidated')
            then 'cache-control: no-cache' || chr(10) || 'content-length: ' || bytes || chr(10) || 'content-type: text/html' || chr(10) || 'date: ' || ts end as headers
from s
"""

#: crc32 of a text's bytes, from the table that its polynomial gives
_CRC_TABLE = """
  select list_transform(range(256), lambda i: list_reduce(list_concat([cast(i as bigint)], range(8)),
           lambda c, k: case when c & 1 = 1 then xor(3988292384, c >> 1) else c >> 1 end)) as t
"""
_CRC = """xor(list_reduce(list_concat([4294967295], list_transform(range(1, len(x) + 1, 2), lambda i: cast('0x' || substr(x, i, 2) as bigint))),
                lambda c, b: xor(t[cast((xor(c, b) & 255) + 1 as int)], c >> 8)), 4294967295)"""

ORACLE["op13_spelling_variants"] = """
with recursive tab as (TABLE),
runs as (
  select doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                           '[A-Za-zÀ-ÿ]+')) as run
  from documents),
u as (
  select doc_id, run, count(*) as n, hex(encode(coalesce(cast(doc_id as varchar), '') || ':' || run)) as x from runs group by doc_id, run),
h as (
  select run, n, CRC as h
  from u, tab),
m as (
  select case when h % 97 = 0 then substr(run, 1, cast(h % length(run) as int)) || substr(run, cast(h % length(run) as int) + 2) else run end as word, n from h),
w as (
  select word, cast(sum(n) as bigint) as n from m where length(word) >= 5 group by word having sum(n) >= 3),
d as (
  select word, n, unnest(range(1, length(word) + 1)) as p from w),
k as (
  select word, n, p, substr(word, 1, cast(p as int) - 1) || substr(word, cast(p as int) + 1) as cut from d),
near as (
  select a.word, b.word as near, b.n as near_n from k a join k b on a.p = b.p and a.cut = b.cut and a.word <> b.word
  union
  select k.word, w.word, w.n from k join w on k.cut = w.word
  union
  select w.word, k.word, k.n from k join w on k.cut = w.word),
f as (
  select w.word, w.n, count(near.near) as n_near, max(near_n) as most from w left join near on near.word = w.word group by w.word, w.n),
g as (
  select f.word, f.n, f.n_near, min(near.near) as form, any_value(near.near_n) as form_n
  from f left join near on near.word = f.word and near.near_n = f.most and f.most >= 2 * f.n group by f.word, f.n, f.n_near),
r as (
  select word, word as at, form as next from g
  union all
  select r.word, g.word, g.form from r join g on g.word = r.next)
select g.word, g.form, r.at as root, g.n, g.n_near, g.form_n from g join r on r.word = g.word and r.next is null
""".replace("TABLE", _CRC_TABLE).replace("CRC", _CRC)

ORACLE["op12_prefix_trie"] = """
with recursive tab as (TABLE),
t as (
  select conv_id, row_number() over (partition by conv_id order by turn nulls first, role, text) as p, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
x as (
  select conv_id, hex(encode(cast(conv_id as varchar))) as x from t group by conv_id),
h as (
  select conv_id, CRC % 6 as h from x, tab),
r as (
  select h.conv_id, t.p, t.role, t.text from h join t on t.conv_id = h.conv_id - h.conv_id % 100 and t.p <= h.h
  union all
  select h.conv_id, t.p + 1000000, t.role, t.text from h join t on t.conv_id = h.conv_id and t.p > h.h),
s as (
  select conv_id, row_number() over (partition by conv_id order by p) as d, md5(role || chr(31) || text) as k, length(text) as len from r),
c as (
  select conv_id, d, len, string_agg(k, '') over (partition by conv_id order by d rows unbounded preceding) as path from s
  union all
  select conv_id, 0, 0, '' from h),
e as (
  select conv_id, max(d) as d, max_by(path, d) as path from c group by conv_id),
n as (
  select path, any_value(d) as depth, min(conv_id) as conv_id, count(*) as n_convs, (count(*) - 1) * any_value(len) as own,
         case when any_value(d) > 0 then substr(path, 1, length(path) - 32) end as parent
  from c group by path),
k as (
  select n.path, count(m.path) as n_children from n left join n m on m.parent = n.path group by n.path),
f as (
  select n.*, k.n_children from n join k on k.path = n.path),
b as (
  select path as top, path, own, n_children from f
  union all
  select f.parent, b.path, b.own, b.n_children from b join f on f.path = b.top where f.parent is not null),
u as (
  select top, count(*) filter (n_children = 0) as n_leaves, sum(own) as saved from b group by top),
l as (
  select path, string_agg(cast(conv_id as varchar), ',' order by conv_id) as ids from e group by path)
select f.conv_id, cast(f.depth as bigint) as depth, p.conv_id as parent_conv_id, f.n_convs, f.n_children, u.n_leaves,
       cast(u.saved as bigint) as saved_tokens, sha256(coalesce(l.ids, '')) as ends_sha256
from f join u on u.top = f.path left join f p on p.path = f.parent left join l on l.path = f.path
""".replace("TABLE", _CRC_TABLE).replace("CRC", _CRC)
