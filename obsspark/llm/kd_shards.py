"""K-d tree sharding at distributed weighted medians, DataFrame functions only.

One scan writes a narrow table (row id, doc_id, size, checksum and the metadata
dimensions as ordered numbers).  From then on, a node of the tree is split along the dimension in
which it is widest, relative to the whole table, so that both sides get bytes in
proportion to their leaves.  The cut is found by narrowing an interval: sums of
bytes in BINS bins of each open node, one partial aggregation for all nodes of a
level, then the same inside the bin that holds the median.  Rows that tie in the
dimension are ordered by a hash of their doc_id, and equal ids by row id, so a value
that a third of all rows share is split like any other.  What reaches the driver are
BINS sums for each of the open nodes, which depends on the number of shards alone.

Defined cases: null text has size 1 and the checksum of the empty text; null
dimensions sort first; equal rows are told apart by their place in the input; an
empty table gives an empty result; columns other than doc_id, text and the dimensions
are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType

from obsspark.llm.common import stored, utf8

BINS = 1024
#: a cut may miss its share of bytes by this part of a shard, or by one row
TOLERANCE = 0.002


def ordered_number(df: DataFrame, name: str) -> Column:
    """A long >= 0 in the order of the column, null lowest; for text by its first seven bytes."""
    if isinstance(df.schema[name].dataType, NumericType):
        value = F.greatest(F.col(name).cast("long"), F.lit(-1).cast("long")) + 1
        return F.coalesce(value, F.lit(0).cast("long"))
    head = F.substring(F.col(name).cast("string").cast("binary"), 1, 7)
    return F.coalesce(F.conv(F.rpad(F.hex(head), 14, "0"), 16, 10).cast("long") + 1, F.lit(0).cast("long"))


@dataclass
class Node:
    leaves: int
    dim: int = 0
    #: rows up to (dimension, hash, row id) go to the left
    cut: tuple[int, int, int] | None = None
    children: tuple["Node", "Node"] | None = None
    #: bytes that belong to the left side and are not placed yet, and the open interval
    want: float = 0.0
    fixed: list[int] = field(default_factory=list)
    lo: int = 0
    hi: int = 0

    def split(self) -> None:
        left = self.leaves // 2
        self.children = (Node(left), Node(self.leaves - left))


def _leq(row: tuple[Column, Column, Column], cut: tuple[int, int, int]) -> Column:
    a, b, c = row
    x, y, z = (F.lit(v) for v in cut)
    return (a < x) | ((a == x) & ((b < y) | ((b == y) & (c <= z))))


def _place(node: Node, leaf: dict[int, Column], dims: list[str]) -> Column:
    """Nested CASE down the tree; ``leaf`` has the value of each open node or shard."""
    if id(node) in leaf:
        return leaf[id(node)]
    if node.children is None:  # a shard that is done
        return F.lit(-1)
    left, right = node.children
    row = (F.col(dims[node.dim]), F.col("tie"), F.col("rid"))
    return F.when(_leq(row, node.cut), _place(left, leaf, dims)).otherwise(_place(right, leaf, dims))


def _case(which: Column, values: list) -> Column:
    out = F.lit(values[-1])
    for i in range(len(values) - 2, -1, -1):
        out = F.when(which == i, F.lit(values[i])).otherwise(out)
    return out


def _widest(rows: DataFrame, root: Node, nodes: list[Node], dims: list[str], spread: list[int]) -> None:
    """Set each node's widest dimension, its interval there and the bytes wanted on the left."""
    which = _place(root, {id(n): F.lit(i) for i, n in enumerate(nodes)}, dims)
    ranges = [f(d).alias(f"{k}{i}") for i, d in enumerate(dims) for k, f in (("lo", F.min), ("hi", F.max))]
    stats = {r.node: r for r in rows.select(which.alias("node"), "size", *dims).groupBy("node").agg(F.sum("size").alias("bytes"), *ranges).collect()}
    for i, node in enumerate(nodes):
        if i not in stats:
            continue
        r = stats[i]
        widths = [(r[f"hi{d}"] - r[f"lo{d}"]) / (spread[d] or 1) for d in range(len(dims))]
        node.dim = max(range(len(dims)), key=lambda d: (widths[d], -d))
        node.lo, node.hi = r[f"lo{node.dim}"], r[f"hi{node.dim}"]
        node.want = r.bytes * (node.leaves // 2) / node.leaves
        node.fixed = []


def _narrow(rows: DataFrame, root: Node, nodes: list[Node], dims: list[str], slack: float) -> None:
    """Find the cuts of one level's nodes, one aggregation a round for all of them."""
    open_nodes = [n for n in nodes if n.hi >= n.lo]
    while open_nodes:
        leaf = {id(n): F.lit(-1) for n in nodes} | {id(n): F.lit(i) for i, n in enumerate(open_nodes)}
        which = F.col("node")
        # the ordering component that a node is narrowing: dimension, then tie, then row id
        parts, inside = [], F.lit(False)
        for i, n in enumerate(open_nodes):
            row = (F.col(dims[n.dim]), F.col("tie"), F.col("rid"))
            here = which == i
            for k, v in enumerate(n.fixed):
                here = here & (row[k] == F.lit(v))
            level = row[len(n.fixed)]
            inside = inside | (here & (level >= F.lit(n.lo)) & (level <= F.lit(n.hi)))
            parts.append((which == i, level))
        value = parts[-1][1]
        for cond, level in parts[-2::-1]:
            value = F.when(cond, level).otherwise(value)
        step = _case(which, [max(1, -(-(n.hi - n.lo + 1) // BINS)) for n in open_nodes])
        start = _case(which, [n.lo for n in open_nodes])
        placed = rows.select(_place(root, leaf, dims).alias("node"), "size", "tie", "rid", *dims)
        binned = (placed.filter(which >= 0).filter(inside).select("node", "size", value.alias("v"), step.alias("step"), start.alias("start"))
                  .withColumn("bin", F.expr("(v - start) div step"))
                  .groupBy("node", "bin").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
                                              F.min("v").alias("lo"), F.max("v").alias("hi")))
        bins: dict[int, list] = {}
        for r in binned.collect():
            bins.setdefault(r.node, []).append(r)
        still = []
        for i, node in enumerate(open_nodes):
            below, last = 0, None
            for r in sorted(bins.get(i, []), key=lambda r: r.bin):
                if below + r.bytes > node.want:
                    last = r
                    break
                below, end = below + r.bytes, r.hi
                node.cut = (*node.fixed, end, *([2 ** 63 - 1] * (2 - len(node.fixed))))
            if last is None:
                continue
            node.want -= below
            if node.cut is None:  # nothing is placed on the left yet
                node.cut = (-1, -1, -1)
            if min(node.want, last.bytes - node.want) <= slack or last.n == 1:
                if node.want > last.bytes / 2:
                    node.cut = (*node.fixed, last.hi, *([2 ** 63 - 1] * (2 - len(node.fixed))))
                continue
            if last.lo == last.hi:
                node.fixed = [*node.fixed, last.lo]
                node.lo, node.hi = 0, 2 ** 62
            else:
                node.lo, node.hi = last.lo, last.hi
            still.append(node)
        open_nodes = still


def kd_tree(rows: DataFrame, dims: list[str], shards: int) -> Node:
    total = rows.agg(F.sum("size").alias("bytes"), *[(F.max(d) - F.min(d)).alias(d) for d in dims]).first()
    root = Node(shards)
    spread = [total[d] or 0 for d in dims]
    level = [root]
    while level := [n for n in level if n.leaves > 1]:
        _widest(rows, root, level, dims, spread)
        _narrow(rows, root, level, dims, TOLERANCE * (total.bytes or 0) / shards)
        for node in level:
            node.cut = node.cut or (-1, -1, -1)
            node.split()
        level = [c for n in level for c in n.children]
    return root


def _leaves(node: Node) -> list[Node]:
    return [node] if node.children is None else [x for c in node.children for x in _leaves(c)]


def shard_rows(docs: DataFrame, dims: tuple[str, ...] = ("source", "lang", "n_chars"), shards: int | None = None,
               target_bytes: int | None = None) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard, slot (gapless from 0 in each shard).

    Either the number of shards or the bytes that a shard should reach is given.
    """
    text = utf8(F.col("text"))
    own = [f"dim{i}" for i in range(len(dims))]
    rows = stored(docs.select(
        F.monotonically_increasing_id().alias("rid"), "doc_id",
        (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"), F.shiftrightunsigned(F.xxhash64("doc_id"), 2).alias("tie"),
        *[ordered_number(docs, d).alias(o) for d, o in zip(dims, own, strict=True)]), "shard-rows")
    if shards is None:
        shards = max(1, -(-(rows.agg(F.sum("size")).first()[0] or 0) // target_bytes))
    root = kd_tree(rows, own, shards)
    shard = _place(root, {id(n): F.lit(i) for i, n in enumerate(_leaves(root))}, own)
    # a run: the rows that one input split gives to a shard; runs are counted, then rows numbered within each
    placed = rows.select("rid", "doc_id", "size", "text_crc32", shard.cast("int").alias("shard"), F.shiftright("rid", 33).alias("run"))
    runs = (placed.groupBy("shard", "run").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("run")) - F.col("n"))
            .select(F.col("shard").alias("s"), F.col("run").alias("r"), "before"))
    numbered = placed.withColumn("at", F.row_number().over(Window.partitionBy("shard", "run").orderBy("rid")) - 1)
    return (numbered.join(runs, (F.col("shard") == F.col("s")) & (F.col("run") == F.col("r")))
            .select("doc_id", "size", "text_crc32", "shard", (F.col("before") + F.col("at")).cast("long").alias("slot")))
