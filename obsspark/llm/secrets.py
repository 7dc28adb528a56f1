"""Secret scan by character Markov models, DataFrame functions only.

Base rules give spans of three kinds.  The method adds a fourth, ``random``: a long token
outside those spans whose characters follow each other as in random strings rather than as in
ordinary identifiers.  Two first-order Markov models, one of each class, are trained from
labelled samples: the values that the base rules find are labelled random, tokens outside of
them that have more than one pair of neighbouring tokens in the sample ordinary.  Each token trains
a model once, however often it comes, and a token of the ordinary class is itself tested without its
own share in that class, so that copies do not make a token ordinary.
The sample is bounded by TRAIN_DOCS, chosen by hash; a token counts if the log-likelihood ratios of its different pairs of characters add up to MIN_RATIO.

Positions come from the lengths of the pieces between matches, summed per document by a
window over the matches alone; texts are read by two scans and never shuffled.

Defined cases: null text counts as empty and has no spans; equal rows are scanned each for
itself; without any labelled random string that model is uniform; an empty table gives an empty result;
columns other than doc_id and text are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsspark.llm.common import small_join, stored, utf8

# fixed values: the base rules and their least lengths
ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
LEAST = {"assign": 12, "access": 18, "hex": 16}
#: runs shorter than the least length cannot be part of a longer match of the same rule
ACCESS_LONG, HEX_LONG = r"AKIA[A-Z0-9]{14,}", r"[0-9a-f]{16,}"
KINDS = ("assign", "access", "hex", "random")

#: characters and least length of tokens that are tested
TOKEN = r"[A-Za-z0-9+/_-]{16,}={0,2}"
ORDINARY = r"[A-Za-z0-9+/_-]{6,}"
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789+/_-=."
SMOOTHING, BACK_OFF = 0.5, 8.0
#: log-likelihood ratio (natural) from which a token is taken for random
MIN_RATIO = 12.0
#: expected number of documents that the models are trained on, at most
TRAIN_DOCS = 4000


def _matches(text: Column, pattern: str, group: int, kind: int) -> Column:
    """Structs (kind, i, gap, len, value): a match, and the characters between the one before and it."""
    p = F.lit(pattern)
    zipped = F.arrays_zip(F.split(text, pattern, -1).alias("gap"), F.regexp_extract_all(text, p, F.lit(0)).alias("whole"),
                          F.regexp_extract_all(text, p, F.lit(group)).alias("value"))
    found = F.transform(zipped, lambda z, i: F.struct(
        F.lit(kind).alias("kind"), i.alias("i"), F.length(z["gap"]).cast("long").alias("gap"),
        F.length(z["whole"]).cast("long").alias("len"), z["value"].alias("value")))
    none = F.array().cast("array<struct<kind:int,i:int,gap:bigint,len:bigint,value:string>>")
    return F.when(text.rlike(pattern), found).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """(rid, doc_id, items): the matches of all rules and the tokens to test."""
    text = utf8(F.col("text"))
    items = F.concat(_matches(text, ASSIGN, 2, 0), _matches(text, ACCESS_LONG, 0, 1), _matches(text, HEX_LONG, 0, 2),
                     _matches(text, TOKEN, 0, 3))
    # the piece after the last match has none
    return stored(docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id",
                              F.filter(items, lambda x: x["len"].isNotNull()).alias("items")), "secret-items")


def spans(scanned: DataFrame) -> DataFrame:
    """(rid, kind, start, end, value) of the base spans, and of the tokens to test that touch none of them."""
    rows = scanned.filter(F.size("items") > 0).select("rid", F.explode("items").alias("x")).select("rid", "x.*")
    upto = Window.partitionBy("rid", "kind").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto)).withColumn("start", F.col("end") - F.col("len"))
    rows = rows.filter((F.col("kind") != 0) | (F.length("value") >= LEAST["assign"]))
    order = Window.partitionBy("rid").orderBy("start", "kind")
    base_end = F.max(F.when(F.col("kind") < 3, F.col("end"))).over(order.rowsBetween(Window.unboundedPreceding, -1))
    base_start = F.min(F.when(F.col("kind") < 3, F.col("start"))).over(order.rowsBetween(1, Window.unboundedFollowing))
    free = (F.coalesce(base_end, F.lit(0)) <= F.col("start")) & (F.coalesce(base_start, F.col("end")) >= F.col("end"))
    return (rows.withColumn("free", free).filter((F.col("kind") < 3) | F.col("free"))
            .select("rid", "kind", "start", "end", "value"))


def _bigrams(tokens: DataFrame) -> DataFrame:
    """Counts of neighbouring characters in (token, n)."""
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2))))
    return (tokens.filter(F.length("token") > 1).select(grams.alias("gram"), "n")
            .groupBy("gram").agg(F.sum("n").alias("n")))


def _ordinary(rest: DataFrame) -> DataFrame:
    """Tokens of ``rest`` that come between different neighbours, once each."""
    tokens = rest.select(F.regexp_extract_all("rest", F.lit(ORDINARY), F.lit(0)).alias("all"))
    # copies of a passage have one context
    near = lambda i: F.coalesce(F.try_element_at("all", i), F.lit(""))
    each = F.transform("all", lambda x, i: F.struct(
        x.alias("token"), F.xxhash64(F.when(i > 0, near(F.greatest(i, F.lit(1)))).otherwise(""), near(i + 2)).alias("context")))
    return (tokens.select(F.explode(each).alias("x")).groupBy("x.token")
            .agg(F.min("x.context").alias("low"), F.max("x.context").alias("high")).filter("low < high").select("token"))


def _without_itself(tokens: DataFrame, table: DataFrame, whole: float) -> DataFrame:
    """(token, own_total): the sum of ratios of each token of the ordinary class if the class did not have it."""
    grams = F.explode(F.transform(F.sequence(F.lit(1), F.length("token") - 1), lambda i: F.substring("token", i, F.lit(2))))
    own = tokens.select("token", grams.alias("gram")).groupBy("token", "gram").agg(F.count(F.lit(1)).alias("own"))
    by = lambda *c: F.sum("own").over(Window.partitionBy("token", *c))
    own = (own.withColumn("own_row", by(F.substring("gram", 1, 1))).withColumn("own_second", by(F.substring("gram", 2, 1)))
           .withColumn("own_all", by()).join(F.broadcast(table), F.col("gram") == F.col("g")))
    follows = (F.col("second") - F.col("own_second")) / (F.lit(whole) - F.col("own_all"))
    ordinary = F.log((F.col("n") - F.col("own") + BACK_OFF * follows) / (F.col("row") - F.col("own_row") + BACK_OFF))
    return own.groupBy("token").agg(F.sum(F.col("random") - ordinary).alias("own_total"))


def ratios(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> tuple[DataFrame, DataFrame]:
    """(g, ratio): log-likelihood ratio of every pair of characters; the table has len(ALPHABET) ** 2 rows.

    And (token, own_total) of the tested tokens that are in the ordinary class.
    """
    total = docs.count()
    draw = F.shiftrightunsigned(F.xxhash64(F.lit("secrets"), F.col("doc_id")), 1) / F.lit(float(1 << 63))
    sample = docs.filter(draw < train_docs / max(total, 1)).select(utf8(F.col("text")).alias("text"))
    values = F.concat(*[F.when(F.col("text").rlike(p), F.regexp_extract_all("text", F.lit(p), F.lit(g))).otherwise(F.array().cast("array<string>"))
                        for p, g in ((ASSIGN, 2), (ACCESS_LONG, 0), (HEX_LONG, 0))])
    rest = F.col("text")
    for p in (ASSIGN, ACCESS_LONG, HEX_LONG):
        rest = F.when(rest.rlike(p), F.regexp_replace(rest, F.lit(p), F.lit(" "))).otherwise(rest)
    labelled = (sample.select(F.explode(values).alias("token")).filter(F.length("token") >= 12).distinct().withColumn("label", F.lit(1))
                .unionByName(_ordinary(sample.select(rest.alias("rest"))).withColumn("label", F.lit(0))).withColumn("n", F.lit(1)))
    labelled = stored(labelled, "secret-samples")
    counts = [{r.gram: r.n for r in _bigrams(labelled.filter(F.col("label") == label)).filter(F.col("gram").rlike(r"^[A-Za-z0-9+/_.=-]{2}$")).collect()}
              for label in (0, 1)]
    logs, sums = [], []
    for table in counts:
        # pairs not seen fall back on how often their second character follows any
        rows = {a: sum(table.get(a + b, 0) for b in ALPHABET) for a in ALPHABET}
        second = {b: sum(table.get(a + b, 0) for a in ALPHABET) + SMOOTHING for b in ALPHABET}
        whole = sum(second.values())
        logs.append({a + b: math.log((table.get(a + b, 0) + BACK_OFF * second[b] / whole) / (rows[a] + BACK_OFF))
                     for a in ALPHABET for b in ALPHABET})
        sums.append((rows, second, whole))
    spark, (rows, second, whole) = docs.sparkSession, sums[0]
    parts = spark.createDataFrame([(g, logs[1][g], float(counts[0].get(g, 0)), float(rows[g[0]]), float(second[g[1]])) for g in logs[0]],
                                  "g string, random double, n double, row double, second double")
    tested = labelled.filter((F.col("label") == 0) & (F.length("token") >= 16)).select("token")
    return (spark.createDataFrame([(g, logs[1][g] - logs[0][g]) for g in logs[0]], "g string, ratio double"),
            stored(_without_itself(tested, parts, whole), "secret-own"))


def random_spans(found: DataFrame, table: DataFrame, own: DataFrame, min_ratio: float = MIN_RATIO) -> DataFrame:
    """The tested tokens that are taken for random."""
    tokens = small_join(found.filter(F.col("kind") == 3), own, F.rtrim("value", F.lit("=")) == F.col("token"), "left", own.count())
    # a pair that comes again in a token is no further evidence: a run of one character is not random
    grams = F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), F.length("value") - 1), lambda i: F.substring("value", i, F.lit(2)))))
    pairs = tokens.select("rid", "start", "end", "own_total", grams.alias("gram"))
    return (pairs.join(F.broadcast(table), F.col("gram") == F.col("g"))
            .groupBy("rid", "start", "end").agg(F.coalesce(F.first("own_total"), F.sum("ratio")).alias("total"))
            .filter(F.col("total") >= min_ratio).select("rid", F.lit(3).alias("kind"), "start", "end"))


def scan_secrets(docs: DataFrame, min_ratio: float = MIN_RATIO, train_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, n_random, base_sha256, spans."""
    scanned = scan(docs)
    found = stored(spans(scanned), "secret-spans")
    rows = found.filter(F.col("kind") < 3).select("rid", "kind", "start", "end").unionByName(
        random_spans(found, *ratios(docs, train_docs), min_ratio))
    listed = F.array_sort(F.collect_list(F.struct("start", "kind", "end")))
    count = [F.count(F.when(F.col("kind") == k, 1)).alias(f"n_{name}") for k, name in enumerate(KINDS)]
    by_doc = rows.groupBy("rid").agg(listed.alias("all"), *count).withColumnRenamed("rid", "r")
    names = F.array(*[F.lit(k) for k in KINDS])
    text = lambda a: F.array_join(F.transform(a, lambda x: F.concat_ws(":", names[x["kind"]], x["start"], x["end"])), ",")
    out = scanned.select("rid", "doc_id").join(by_doc, F.col("rid") == F.col("r"), "left")
    return out.select("doc_id", *[F.coalesce(f"n_{k}", F.lit(0)).cast("long").alias(f"n_{k}") for k in KINDS],
                      F.sha2(F.coalesce(text(F.filter("all", lambda x: x["kind"] < 3)), F.lit("")), 256).alias("base_sha256"),
                      F.coalesce(text(F.col("all")), F.lit("")).alias("spans"))
