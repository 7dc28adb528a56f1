"""WARC: revisit records of the not-modified kind, resolved to full responses.

A revisit is joined as of its time with the latest earlier full response of the same
canonical URL, its validators are checked against that response, and the headers that a
304 may change are merged into the response's.

The as-of join deals all records by ranges of (URL, time, record), so that the records of one
URL, however many, spread over tasks.  Within a range a window finds the latest response;
for the first records of a range, it is the last one of an earlier range, taken from a
table with one row per range and URL.

Defined cases: a revisit with a null URL or time has no earlier response, and a response with one is none; of responses at the same time
the one with the largest record_id is later, and a response at the time of a revisit
is not earlier; a null etag or Last-Modified is no validator; null headers are none;
repeated records are resolved each for itself; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsspark.llm.common import stored

#: headers of a 304 that do not replace those of the stored response
KEPT_HEADERS = ("connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive",
                "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade")


def canonical_url(url: Column) -> Column:
    """Host in lower case without default port, path, and sorted parameters but for tracking ones; no scheme, no fragment.

    What does not begin with a scheme only loses its fragment.
    """
    bare = F.regexp_replace(F.trim(url), "(?s)#.*$", "")
    host = F.regexp_replace(F.lower(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://([^/?]*)", 1)), ":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(bare, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*([^?]*)", 1), "/+$", "")
    params = F.filter(F.split(F.regexp_extract(bare, r"(?s)\?(.*)$", 1), "&"), lambda x: (x != "") & ~x.startswith("utm_"))
    whole = F.concat_ws("?", F.concat(host, path), F.when(F.size(params) > 0, F.array_join(F.array_sort(params), "&")))
    return F.when(bare.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), whole).otherwise(bare)


def folded(headers: Column) -> Column:
    """Headers by lower-case names, which have no case; of names that differ in case alone the last in code-point order stays."""
    none = F.create_map().cast("map<string,string>")

    def put(got: Column, entry: Column) -> Column:
        name = F.lower(entry["key"])
        return F.map_concat(F.map_filter(got, lambda k, v: k != name), F.create_map(name, entry["value"]))

    return F.aggregate(F.array_sort(F.map_entries(F.coalesce(headers, none))), none, put)


def records(pages: DataFrame) -> DataFrame:
    """Capture records of the pages table: a full response per page and a later revisit of it.

    The table has no headers; they follow from page_id and html by fixed rules, so that
    some validators are missing and some do not match.
    """
    page, tag = F.col("page_id"), F.concat(F.lit('"'), F.md5(F.coalesce("html", F.lit(""))), F.lit('"'))
    changed = F.when(page % 5 != 0, (page - page % 7).cast("string"))
    etag = F.when(page % 11 != 0, tag)
    response = pages.select(
        (page * 2).alias("record_id"), "url", page.alias("ts"), F.lit(False).alias("revisit"), etag.alias("etag"), changed.alias("last_modified"),
        F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("content-length"), F.octet_length(F.coalesce("html", F.lit(""))).cast("string"),
                     F.lit("Cache-Control"), F.concat(F.lit("max-age="), (page % 3 * 60).cast("string"))).alias("headers"))
    again = pages.select(
        (page * 2 + 1).alias("record_id"), F.concat("url", F.lit("#again")).alias("url"), (page + 1 + page % 977).alias("ts"), F.lit(True).alias("revisit"),
        F.when(page % 13 == 0, F.lit('"other"')).otherwise(etag).alias("etag"), changed.alias("last_modified"),
        F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("cache-control"), F.lit("no-cache"),
                     F.lit("date"), (page + 1 + page % 977).cast("string")).alias("headers"))
    return response.unionByName(again)


def latest_earlier(rows: DataFrame) -> DataFrame:
    """Revisits with ``full``: the latest earlier response of their URL, null if there is none."""
    full = F.struct("ts", "record_id", "etag", "last_modified", "headers")
    ranged = rows.repartitionByRange("key", "ts", "place", "record_id").withColumn("range", F.spark_partition_id())
    ranged = stored(ranged, "warc-ranges")
    timed = ~F.col("revisit") & F.col("ts").isNotNull()
    # at equal times a revisit comes before a response
    order = Window.partitionBy("range", "key").orderBy("ts", "place", "record_id").rowsBetween(Window.unboundedPreceding, 0)
    answered = ranged.withColumn("full", F.last(F.when(timed, full), ignorenulls=True).over(order)).filter("revisit")
    tails = (ranged.filter(F.col("key").isNotNull())
             .groupBy(F.col("range").alias("r"), F.col("key").alias("k"))
             .agg(F.max_by(full, F.when(timed, F.struct("ts", "record_id"))).alias("tail")))
    before = Window.partitionBy("k").orderBy("r").rowsBetween(Window.unboundedPreceding, -1)
    carry = tails.withColumn("carried", F.last("tail", ignorenulls=True).over(before)).filter("carried is not null").select("r", "k", "carried")
    joined = answered.join(carry, (F.col("range") == F.col("r")) & (F.col("key") == F.col("k")), "left")
    known = F.col("key").isNotNull() & F.col("ts").isNotNull()
    return joined.withColumn("full", F.when(known, F.coalesce("full", "carried")))


def resolve_revisits(captures: DataFrame) -> DataFrame:
    """One row per revisit: record_id, canonical, response_id, state, headers.

    ``state`` is ``resolved`` if the validators agree (the etag if both have one, else
    Last-Modified if both have one), ``unvalidated`` if there is nothing to compare,
    ``mismatch``, or ``missing`` without an earlier response.  ``headers`` are the merged ones of
    resolved and unvalidated revisits, as ``name: value`` lines in order of names, which are
    compared and returned in lower case.
    """
    rows = captures.select("record_id", canonical_url(F.col("url")).alias("key"), "ts", "revisit",
                           F.when(F.col("revisit"), 0).otherwise(1).alias("place"), "etag", "last_modified", "headers")
    found = latest_earlier(rows)
    # weak comparison: a leading W/ does not count
    strong = lambda c: F.regexp_replace(c, "^W/", "")
    by_etag = F.col("etag").isNotNull() & F.col("full.etag").isNotNull()
    by_time = F.col("last_modified").isNotNull() & F.col("full.last_modified").isNotNull()
    agree = (F.when(by_etag, strong(F.col("etag")) == strong(F.col("full.etag")))
             .when(by_time, F.col("last_modified") == F.col("full.last_modified")))
    state = (F.when(F.col("full").isNull(), "missing").when(agree, "resolved").when(~agree, "mismatch").otherwise("unvalidated"))
    new = F.map_filter(folded(F.col("headers")), lambda k, v: ~k.isin(*KEPT_HEADERS))
    old = F.map_filter(folded(F.col("full.headers")), lambda k, v: ~F.array_contains(F.map_keys(new), k))
    lines = F.array_join(F.transform(F.array_sort(F.map_entries(F.map_concat(old, new))), lambda e: F.concat(e["key"], F.lit(": "), F.coalesce(e["value"], F.lit("")))), "\n")
    out = found.withColumn("state", state)
    usable = F.col("state").isin("resolved", "unvalidated")
    return out.select("record_id", F.col("key").alias("canonical"), F.when(usable, F.col("full.record_id")).alias("response_id"),
                      "state", F.when(usable, lines).alias("headers"))
