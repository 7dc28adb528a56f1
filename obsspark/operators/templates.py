"""Recurring messages by template (G8): token positions of a fixed-depth tree with wildcards.

Lines of one message differ in numbers, ids, names and paths.  Tokens are what
white space separates; one with a digit is a wildcard.  Lines with equally
many tokens form a node; at each of the first DEPTH positions a node has one
child per distinct token, or, where there are more than FAN_OUT of them, a
single one under a wildcard.  Behind the last level a position is a token where
all lines of the leaf have the same, else a wildcard.

All of it is counting: distinct lines are aggregated first, children are
counted per node, the positions behind are minima and maxima per leaf.  The
result does not depend on the order in which lines come, and nothing holds the
lines of a node in one place.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsspark.session import keep

DEPTH, FAN_OUT = 3, 16
WILDCARD = "<*>"
_SEPARATOR = "\u0000"


def tokens_of(line: Column) -> Column:
    """Tokens of a line, those with a digit as wildcards."""
    words = F.filter(F.split(line, r"\s+"), lambda t: t != "")
    return F.transform(words, lambda t: F.when(t.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(t))


def line_templates(lines: DataFrame, line_col: str = "line", time_col: str = "rank_ms", depth: int = DEPTH, fan_out: int = FAN_OUT) -> DataFrame:
    """template, n (lines), n_distinct (lines that differ, numbers aside), first_ms, last_ms.

    Lines without a token, or null, have no template."""
    tokens = lines.select(tokens_of(F.col(line_col)).alias("tokens"), F.col(time_col).alias("_t")).filter(F.size("tokens") > 0)
    rows = keep(tokens.groupBy("tokens").agg(F.count(F.lit(1)).alias("n"), F.min("_t").alias("first_ms"), F.max("_t").alias("last_ms"))
                .withColumn("node", F.size("tokens").cast("string")))
    for level in range(depth):
        token = F.coalesce(F.get("tokens", F.lit(level)), F.lit(""))
        children = (rows.groupBy("node", token.alias("_token")).agg(F.count(F.lit(1)).alias("_n")).groupBy(F.col("node").alias("_node"))
                    .agg(F.count(F.lit(1)).alias("_children")))
        step = F.when(F.col("_children") > fan_out, F.lit(WILDCARD)).otherwise(token)
        rows = (rows.join(children, F.col("node") == F.col("_node"))
                .withColumn("node", F.concat("node", F.lit(_SEPARATOR), step)).drop("_node", "_children"))
    leaves = rows.groupBy("node").agg(F.sum("n").alias("n"), F.count(F.lit(1)).alias("n_distinct"), F.min("first_ms").alias("first_ms"), F.max("last_ms").alias("last_ms"))
    behind = F.posexplode(F.slice("tokens", depth + 1, F.greatest(F.size("tokens"), F.lit(1))))
    same = (rows.select("node", behind.alias("at", "token")).groupBy("node", "at").agg(F.min("token").alias("lo"), F.max("token").alias("hi"))
            .select("node", "at", F.when(F.col("lo") == F.col("hi"), F.col("lo")).otherwise(F.lit(WILDCARD)).alias("token")))
    # as many rows as a line of the leaf has tokens
    rest = same.groupBy(F.col("node").alias("_node")).agg(F.transform(F.array_sort(F.collect_list(F.struct("at", "token"))), lambda x: x["token"]).alias("_rest"))
    # the node's first part is the number of tokens; levels behind a line's end are empty
    head = F.filter(F.slice(F.split("node", _SEPARATOR), 2, depth), lambda t: t != "") if depth else F.array().cast("array<string>")
    whole = F.concat(head, F.coalesce("_rest", F.array().cast("array<string>")))
    return (leaves.join(rest, F.col("node") == F.col("_node"), "left")
            .select(F.array_join(whole, " ").alias("template"), "n", "n_distinct", "first_ms", "last_ms"))
