"""Mixing sources to target weights.

Every document has a random key, the MD5 of its doc_id and text, so that reruns
agree.  Keys are cut into ranges by their leading bits; word counts are summed per
(source, range), prefix sums over the ranges find the range in which a source's
budget ends, and only the rows of those ranges are sorted and summed one by one.
A source's whole epochs are taken from all its documents, the rest of its budget from
the documents up to the cut.  Documents are taken whole, so a source's sum differs
from its target by less than half of one document.

Defined cases: null or blank text has size 0 and nothing is taken; null doc_id and
null source are values like others (the null source is last); rows equal in doc_id,
text and source have one key, and where the budget ends among them as many are taken as
fit (which of them makes no difference to ``mixture``); without words all targets are 0;
columns other than doc_id, text and source are ignored by ``mixture`` and kept by
``mix_documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsspark.llm.common import BROADCAST_ROWS, small_join, stored, utf8, word_count

#: rows that a key range of one source is meant to hold at most
RANGE_ROWS = 20_000


def keyed(docs: DataFrame) -> DataFrame:
    """doc_id, source, size and the random key (128 bits as hexadecimal text)."""
    text = utf8(F.col("text"))
    identity = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    return docs.select("doc_id", "source", word_count(F.col("text")).alias("size"), F.md5(identity).alias("key"),
                       F.monotonically_increasing_id().alias("rid"))


def source_targets(sizes: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5,
                   max_epochs: int = 2) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Sources by code point, null last, get the weights in turn.  All sources share
    ``share`` times all words by weight; no target is above ``max_epochs`` times its
    source, and what that leaves goes to the others by weight.  The level at which
    all fits is found by prefix sums over the sources ordered by the ratio at which
    they fill up.  One row per source passes through these windows.
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    cycle = F.array(*[F.lit(w) for w in weights])
    ranked = sizes.withColumn("weight", cycle[(F.row_number().over(order) - 1) % len(weights)].cast("double"))
    ranked = ranked.withColumn("full", (F.col("source_size") * max_epochs).cast("double"))
    filling = Window.orderBy(F.col("full") / F.col("weight"), F.col("source").asc_nulls_last())
    before = filling.rowsBetween(Window.unboundedPreceding, -1)
    whole = Window.partitionBy()
    # if this source and all after it share what those before leave, they get `level` for each unit of weight
    ranked = ranked.withColumn("level", (F.sum("source_size").over(whole) * share - F.coalesce(F.sum("full").over(before), F.lit(0.0)))
                               / (F.sum("weight").over(whole) - F.coalesce(F.sum("weight").over(before), F.lit(0.0))))
    ranked = ranked.withColumn("open", F.col("level") * F.col("weight") <= F.col("full"))
    level = F.first(F.when(F.col("open"), F.col("level")), ignorenulls=True).over(
        filling.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))
    return ranked.withColumn("final", level).select(
        "source", "source_size", F.coalesce(F.least("full", F.col("final") * F.col("weight")), F.col("full")).alias("target"))


def cuts(rows: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
         range_rows: int = RANGE_ROWS) -> DataFrame:
    """Per source: source_size, target, whole epochs, and the cut: documents with a key before cut_key
    are taken once more, and cut_copies of the cut_rows documents with that key."""
    total = rows.count()
    digits = 1
    while total > range_rows * 16 ** digits and digits < 12:
        digits += 1
    part = F.substring("key", 1, digits)
    ranges = stored(rows.groupBy("source", part.alias("part")).agg(F.sum("size").alias("words")), "mix-ranges")
    targets = stored(source_targets(ranges.groupBy("source").agg(F.sum("words").alias("source_size")), weights, share, max_epochs),
                     "mix-targets")
    plan = targets.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0))
    plan = plan.withColumn("rest", F.col("target") - F.col("epochs") * F.col("source_size"))
    upto = F.sum("words").over(Window.partitionBy("source").orderBy("part"))
    ends = (ranges.withColumn("start", upto - F.col("words")).alias("r")
            .join(plan.alias("p"), F.col("r.source").eqNullSafe(F.col("p.source")))
            .filter("rest > start and rest <= start + words")
            .select(F.col("p.source").alias("s"), "part", "start", "rest"))
    # the rows of the ranges in which a budget ends, one by one
    inside = rows.join(F.broadcast(ends) if targets.count() <= BROADCAST_ROWS else ends,
                       F.col("source").eqNullSafe(F.col("s")) & (F.substring("key", 1, digits) == F.col("part")))
    # equal rows have one key, and stand together as a count
    alike = inside.groupBy("s", "key", "size").agg(F.count(F.lit(1)).alias("n"), F.first("start").alias("start"), F.first("rest").alias("rest"),
                                                   F.first("part").alias("part"))
    weight = F.col("size") * F.col("n")
    sums = alike.withColumn("before", F.col("start") - weight + F.sum(weight).over(
        Window.partitionBy("s").orderBy("key", "size").rowsBetween(Window.unboundedPreceding, 0)))
    left = F.col("rest") - F.col("before")
    # a copy is taken if at least half of it fits
    copies = F.when(F.col("size") > 0, F.floor(left / F.col("size") + 0.5)).when(left >= 0, F.col("n")).otherwise(0)
    sums = sums.withColumn("copies", F.least(F.greatest(copies, F.lit(0)), F.col("n")).cast("long"))
    last = sums.groupBy("s").agg(F.max(F.when(F.col("copies") > 0, F.struct("key", "copies", "n"))).alias("last"), F.first("part").alias("part"))
    found = plan.alias("p").join(last, F.col("p.source").eqNullSafe(F.col("s")), "left")
    return stored(found.select("p.source", "source_size", "target", F.col("epochs").cast("int").alias("epochs"),
                               F.when(F.col("rest") <= 0, F.lit("")).otherwise(F.coalesce("last.key", "part", F.lit(""))).alias("cut_key"),
                               F.coalesce("last.copies", F.lit(0)).alias("cut_copies"), F.coalesce("last.n", F.lit(0)).alias("cut_rows")),
                  "mix-cuts")


def _taken(joined: DataFrame, plan: DataFrame, source: str) -> DataFrame:
    """Rows (key, rid, ``source`` and its plan) with ``takes``, how often the mix takes them.

    Only where a budget ends inside a group of equal rows these are numbered: by the input
    splits they lie in, counted, and within each.
    """
    more = F.when((F.col("key") < F.col("cut_key")) | ((F.col("key") == F.col("cut_key")) & (F.col("cut_copies") >= F.col("cut_rows"))), 1).otherwise(0)
    takes = (F.col("epochs") + more).alias("takes")
    if plan.filter("cut_copies < cut_rows").isEmpty():
        return joined.select("*", takes)
    split = (F.col("key") == F.col("cut_key")) & (F.col("cut_copies") < F.col("cut_rows"))
    some = joined.filter(split).withColumn("_run", F.shiftright("rid", 33))
    runs = (some.groupBy(F.col(source).alias("_of"), F.col("_run").alias("_r")).agg(F.count(F.lit(1)).alias("_n"))
            .withColumn("_before", F.sum("_n").over(Window.partitionBy("_of").orderBy("_r")) - F.col("_n")).drop("_n"))
    number = F.row_number().over(Window.partitionBy(source, "_run").orderBy("rid"))
    numbered = (some.withColumn("_at", number).join(runs, F.col(source).eqNullSafe(F.col("_of")) & (F.col("_run") == F.col("_r")))
                .select(*joined.columns, (F.col("epochs") + F.when(F.col("_before") + F.col("_at") <= F.col("cut_copies"), 1).otherwise(0)).alias("takes")))
    return joined.filter(~split).select("*", takes).unionByName(numbered)


def mixture(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
            range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, size, source_size, target, taken."""
    rows = stored(keyed(docs), "mix-rows")
    plan = cuts(rows, weights, share, max_epochs, range_rows).withColumnRenamed("source", "s")
    joined = small_join(rows, plan, F.col("source").eqNullSafe(F.col("s")), "inner", plan.count())
    return _taken(joined, plan, "s").select("doc_id", "size", "source_size", "target", (F.col("size") * F.col("takes")).cast("long").alias("taken"))


def mix_documents(docs: DataFrame, weights: tuple[int, ...] = (3, 1, 2), share: float = 1.5, max_epochs: int = 2,
                  range_rows: int = RANGE_ROWS) -> DataFrame:
    """The mixed corpus: every document as often as the mix takes it, columns as they came."""
    rows = stored(keyed(docs), "mix-rows")
    plan = cuts(rows, weights, share, max_epochs, range_rows)
    plan = plan.select(F.col("source").alias("_source"), "epochs", "cut_key", "cut_copies", "cut_rows")
    text = utf8(F.col("text"))
    identity = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.lit(":"), text)
    kept = docs.select(F.struct(*docs.columns).alias("d"), F.md5(identity).alias("key"), F.col("source").alias("_s"),
                       F.monotonically_increasing_id().alias("rid"))
    joined = small_join(kept, plan, F.col("_s").eqNullSafe(F.col("_source")), "inner", plan.count())
    repeated = _taken(joined, plan, "_source").filter("takes > 0").withColumn("_copy", F.explode(F.sequence(F.lit(1), F.col("takes"))))
    return repeated.select("d.*")
