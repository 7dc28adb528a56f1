"""Connected components of an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsspark.llm.common import stored


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for the nodes of ``edges`` (a, b): equal roots in a component.

    Every round points each node to its smallest neighbour, if smaller, and contracts the
    edges; rounds grow with the logarithm of the nodes.  Minima are taken per map task
    first, so a node with very many edges costs one row per task.
    """
    edges = stored(edges.select("a", "b").filter("a != b"), "cc-edges")
    labels = None
    while not edges.isEmpty():
        both = edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        parent = stored(both.groupBy(F.col("a").alias("n")).agg(F.min("b").alias("low"))
                        .select("n", F.least("n", "low").alias("p")), "cc-parents")
        if labels is None:
            labels = parent.select(F.col("n").alias("node"), F.col("p").alias("root"))
        else:
            labels = (labels.join(parent, F.col("root") == F.col("n"), "left")
                      .select("node", F.coalesce("p", "root").alias("root")))
        one = edges.join(parent, F.col("a") == F.col("n")).select(F.col("p").alias("a"), "b")
        two = one.join(parent, F.col("b") == F.col("n")).select("a", F.col("p").alias("b")).filter("a != b")
        edges = stored(two.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct(), "cc-edges")
        labels = stored(labels, "cc-labels")
    if labels is None:
        return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return labels
