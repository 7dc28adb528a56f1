"""Conversation prefix trie by truncation peeling.

Conversations become rows of turn digests.  Equal ones are merged first, so that a row is
a distinct sequence.  Peeling descends from the deepest turn: at every depth the sequences
that end there are merged with the nodes that survive from below, the group is a node with
all its aggregates, and its last turn is stripped for the next depth.

A cut depth is chosen from counted sizes: the smallest (1, 2, 4, ...) at which no prefix
that several sequences share has more than GROUP_TURNS turns below it.  From the cut on,
one pass over rows grouped by their prefix at the cut peels whole subtrees inside tasks,
however many turns they have; above it, where a prefix may be shared by a third of all
rows, every depth is one distributed regrouping whose partial sums are taken before the
shuffle.  Where no depth qualifies, all depths are peeled that way.  A conversation's
digests (16 bytes a turn) and the text lengths are held in one row, its texts never are.

Defined cases: rows without conv_id take no part; null role or text is empty; turns come
in ascending order, null first, equal turns by their digest; a conversation that is rebuilt
to no turn is a member of the root alone; an empty table has no node, not even a root;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsspark.llm.common import map_arrow, small_join, stored

#: turns below a shared prefix that a task may hold at once
GROUP_TURNS = 1 << 11
#: ids in one piece of a node's id list
PIECE_IDS = 1000
#: children from which a node's row is handed to its children by a broadcast join
MANY_CHILDREN = 10_000
#: conversations that take their first turns from the same one, and turns taken at the most
BLOCK, HEAD = 100, 6

ROOT = b""
_SEQUENCE = "conv_id long, keys array<binary>, lens array<long>"
_NODE = ("key binary, parent binary, depth int, conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, "
         "keys array<binary>, lens array<long>")


def turn_rows(conversations: DataFrame) -> DataFrame:
    """(conv_id, turns): every conversation's digests and text lengths in order."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    digest = F.unhex(F.md5(F.concat(F.char_length(role).cast("string"), F.lit(":"), role, text)))
    return (conversations.filter("conv_id is not null")
            .select("conv_id", F.struct("turn", digest.alias("key"), F.char_length(text).cast("long").alias("len")).alias("t"))
            .groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("turns")))


def rebuilt(turns: DataFrame) -> DataFrame:
    """Every conversation with its first turns replaced by those of its block's first one."""
    heads = (turns.filter(F.col("conv_id") % BLOCK == 0)
             .select(F.col("conv_id").alias("base"), F.slice("turns", 1, HEAD - 1).alias("head")))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEAD).cast("int")
    return (turns.withColumn("base", F.col("conv_id") - F.col("conv_id") % BLOCK).withColumn("h", h)
            .join(heads, "base", "left")
            .select("conv_id", F.concat(F.slice(F.coalesce("head", F.expr("filter(turns, t -> false)")), F.lit(1), F.col("h")),
                                        F.slice("turns", F.col("h") + 1, F.greatest(F.size("turns"), F.lit(1)))).alias("turns")))


def _chain(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Digests of turns -> digests of prefixes: equal for equal sequences of turns alone."""
    for batch in batches:
        out = []
        for digests in batch.column("digests"):
            key, keys = ROOT, []
            for d in digests:
                key = md5(key + d.as_py()).digest()
                keys.append(key)
            out.append(keys)
        yield pa.RecordBatch.from_arrays([batch.column("conv_id"), pa.array(out, pa.list_(pa.binary())), batch.column("lens")], ["conv_id", "keys", "lens"])


def sequences(turns: DataFrame) -> DataFrame:
    """(conv_id, keys, lens) of every conversation: the digests of its prefixes, the lengths of its texts."""
    plain = turns.select("conv_id", F.transform("turns", lambda t: t["key"]).alias("digests"), F.transform("turns", lambda t: t["len"]).alias("lens"))
    return map_arrow(plain, _chain, _SEQUENCE)


def _at(depth: int) -> Column:
    """A row's prefix of ``depth`` turns."""
    return F.col("keys")[depth - 1]


class _Peeler:
    """Nodes of the sequences handed in, from their deepest turn up to depth ``cut``."""

    def __init__(self, cut: int) -> None:
        self.cut, self.ended, self.turns = cut, {}, 0

    def add(self, keys: list[bytes], lens: list[int], n: int, conv_id: int) -> None:
        self.ended.setdefault(len(keys), []).append((keys, lens, n, conv_id))
        self.turns += len(keys)

    def nodes(self) -> Iterator[tuple]:
        alive: dict[bytes, list] = {}  # key -> keys, lens, n_convs, conv_id, n_children, n_leaves, saved_tokens
        for depth in range(max(self.ended, default=self.cut - 1), self.cut - 1, -1):
            for keys, lens, n, conv_id in self.ended.get(depth, ()):
                node = alive.setdefault(keys[-1], [keys, lens, 0, conv_id, 0, 0, 0])
                node[2] += n
                node[3] = min(node[3], conv_id)
            above: dict[bytes, list] = {}
            for key, (keys, lens, n, conv_id, children, leaves, saved) in alive.items():
                leaves = leaves if children else 1
                saved += (n - 1) * lens[depth - 1]
                parent = keys[depth - 2] if depth > 1 else ROOT
                top = depth == self.cut
                yield (key, parent, depth, conv_id, n, children, leaves, saved, keys[:depth - 1] if top else None, lens[:depth - 1] if top else None)
                if not top:
                    node = above.setdefault(parent, [keys, lens, 0, conv_id, 0, 0, 0])
                    node[2] += n
                    node[3] = min(node[3], conv_id)
                    node[4] += 1
                    node[5] += leaves
                    node[6] += saved
            alive = above


_COLUMNS = [f.split()[0] for f in _NODE.split(", ")]
_TYPES = [pa.binary(), pa.binary(), pa.int32(), *[pa.int64()] * 5, pa.list_(pa.binary()), pa.list_(pa.int64())]


def _peel(cut: int):
    def out(peeler: _Peeler) -> Iterator[pa.RecordBatch]:
        rows = []
        for node in peeler.nodes():
            rows.append(node)
            if len(rows) == 10_000:
                yield _batch(rows)
                rows = []
        if rows:
            yield _batch(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        peeler, group = _Peeler(cut), None
        for batch in batches:
            columns = [batch.column(c) for c in ("top", "keys", "lens", "n", "conv_id")]
            for row in zip(*columns, strict=True):
                top, keys, lens, n, conv_id = (v.as_py() for v in row)
                if top != group:
                    # whole subtrees are peeled together until they fill a task's share
                    if peeler.turns >= GROUP_TURNS:
                        yield from out(peeler)
                        peeler = _Peeler(cut)
                    group = top
                peeler.add(keys, lens, n, conv_id)
        yield from out(peeler)
    return run


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _COLUMNS)


def cut_depth(distinct: DataFrame, deepest: int) -> int:
    """The smallest depth of 1, 2, 4, ... whose shared prefixes have at most GROUP_TURNS turns below them, deepest + 1 if none."""
    depths = [1]
    while depths[-1] <= deepest:
        depths.append(2 * depths[-1])
    grid = F.array(*[F.lit(d) for d in depths])
    at = (distinct.select(F.explode(F.filter(grid, lambda d: d <= F.size("keys"))).alias("d"), "keys")
          .groupBy("d", F.element_at("keys", F.col("d")).alias("key")).agg(F.sum(F.size("keys").cast("long")).alias("turns"), F.count(F.lit(1)).alias("n"))
          .filter("n > 1").groupBy("d").agg(F.max("turns").alias("turns")).collect())
    most = {r.d: r.turns for r in at}
    return next((d for d in depths if d <= deepest and most.get(d, 0) <= GROUP_TURNS), deepest + 1)


def trie_nodes(seqs: DataFrame) -> DataFrame:
    """(key, parent, depth, conv_id, n_convs, n_children, n_leaves, saved_tokens) of every node; the root has no parent."""
    end = F.when(F.size("keys") > 0, F.element_at("keys", -1)).otherwise(F.lit(bytearray(ROOT)))
    distinct = stored(seqs.groupBy(end.alias("end")).agg(F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("conv_id"),
                                                         F.first("keys").alias("keys"), F.first("lens").alias("lens")), "trie-sequences")
    deepest = distinct.agg(F.max(F.size("keys"))).first()[0]
    if deepest is None:
        return stored(distinct.sparkSession.createDataFrame([], _NODE), "trie-nodes").drop("keys", "lens")
    cut = cut_depth(distinct, deepest)
    done, alive = [], None
    if cut <= deepest:
        subtrees = (distinct.filter(F.size("keys") >= cut).select(_at(cut).alias("top"), "keys", "lens", "n", "conv_id")
                    .repartition("top").sortWithinPartitions("top"))
        below = stored(map_arrow(subtrees, _peel(cut), _NODE), "trie-subtrees")
        done.append(below)
        alive = below.filter(F.col("depth") == cut)
    for depth in range(min(cut, deepest + 1) - 1, -1, -1):
        ended = distinct.filter(F.size("keys") == depth)
        zero = F.lit(0).cast("long")
        rows = ended.select("conv_id", "n", zero.alias("children"), zero.alias("leaves"), zero.alias("saved"), "keys", "lens")
        if alive is not None:
            rows = rows.unionByName(alive.select("conv_id", F.col("n_convs").alias("n"), F.lit(1).cast("long").alias("children"),
                                                 F.col("n_leaves").alias("leaves"), F.col("saved_tokens").alias("saved"), "keys", "lens"))
        rows = rows.withColumn("key", _at(depth) if depth else F.lit(bytearray(ROOT)))
        own = F.expr("(n_convs - 1) * element_at(lens, -1)") if depth else zero
        grouped = (rows.groupBy("key").agg(F.min("conv_id").alias("conv_id"), F.sum("n").alias("n_convs"), F.sum("children").alias("n_children"),
                                           F.sum("leaves").alias("leaves"), F.sum("saved").alias("saved"),
                                           F.first("keys").alias("keys"), F.first("lens").alias("lens")))
        parent = F.expr("element_at(keys, -2)") if depth > 1 else F.lit(bytearray(ROOT)) if depth else F.lit(None).cast("binary")
        strip = [F.slice(c, 1, max(depth - 1, 0)).alias(c) for c in ("keys", "lens")]
        alive = stored(grouped.select(
            "key", parent.alias("parent"), F.lit(depth).alias("depth"), "conv_id", "n_convs", "n_children",
            F.when(F.col("n_children") > 0, F.col("leaves")).otherwise(1).cast("long").alias("n_leaves"),
            (F.col("saved") + own).cast("long").alias("saved_tokens"), *strip), "trie-depth")
        done.append(alive)
    nodes = done[0]
    for more in done[1:]:
        nodes = nodes.unionByName(more)
    return nodes.drop("keys", "lens")


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted (node, conv_id) -> (node, first, ids): runs of a node's ids, comma-joined."""
    node, ids, out = None, [], []

    def close() -> None:
        if ids:
            out.append((node, ids[0], ",".join(map(str, ids))))
            ids.clear()

    def batch_of() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.binary(), pa.int64(), pa.string()), strict=True)],
                                          ["node", "first", "ids"])
        out.clear()
        return done

    for batch in batches:
        for key, conv_id in zip(batch.column("node").to_pylist(), batch.column("conv_id").to_pylist(), strict=True):
            if key != node or len(ids) >= PIECE_IDS:
                close()
                node = key
            ids.append(conv_id)
        if len(out) >= 1000:
            yield batch_of()
    close()
    if out:
        yield batch_of()


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted pieces -> (node, ends): the SHA-256 of every node's whole list, a piece at a time."""
    node, digest, out = None, None, []

    def batch_of() -> pa.RecordBatch:
        done = pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.binary()), pa.array([d for _, d in out], pa.string())], ["node", "ends"])
        out.clear()
        return done

    for batch in batches:
        for key, ids in zip(batch.column("node").to_pylist(), batch.column("ids"), strict=True):
            if key != node:
                if digest is not None:
                    out.append((node, digest.hexdigest()))
                node, digest = key, sha256(ids.as_py().encode())
            else:
                digest.update(b"," + ids.as_py().encode())
        if len(out) >= 10_000:
            yield batch_of()
    if digest is not None:
        out.append((node, digest.hexdigest()))
    if out:
        yield batch_of()


def ends_digests(seqs: DataFrame) -> DataFrame:
    """(node, ends): SHA-256 of the ascending ids of the conversations that end at a node.

    Rows are sorted by (node, id) over ranges, which split a node that very many
    conversations end at; what one task then takes in order are pieces of PIECE_IDS ids.
    """
    end = F.when(F.size("keys") > 0, F.element_at("keys", -1)).otherwise(F.lit(bytearray(ROOT)))
    ids = seqs.select(end.alias("node"), "conv_id").repartitionByRange("node", "conv_id").sortWithinPartitions("node", "conv_id")
    pieces = map_arrow(ids, _pieces, "node binary, first long, ids string")
    return map_arrow(pieces.repartition("node").sortWithinPartitions("node", "first").select("node", "ids"), _digests, "node binary, ends string")


def with_parents(nodes: DataFrame) -> DataFrame:
    """Add parent_conv_id.  Children of nodes with very many get it by a broadcast of those few nodes while they are few."""
    inner = nodes.filter("n_children > 0").select(F.col("key").alias("_key"), F.col("conv_id").alias("parent_conv_id"), "n_children")
    many = inner.filter(F.col("n_children") > MANY_CHILDREN).drop("n_children")
    hot = small_join(nodes, many, F.col("parent") == F.col("_key"), "left", many.count())
    rest = inner.filter(F.col("n_children") <= MANY_CHILDREN).drop("n_children")
    root = nodes.filter("parent is null").withColumn("parent_conv_id", F.lit(None).cast("long"))
    return (hot.filter("_key is not null").drop("_key")
            .unionByName(nodes.filter("parent is not null").join(rest, F.col("parent") == F.col("_key")).drop("_key"))
            .unionByName(root))


def prefix_trie(conversations: DataFrame) -> DataFrame:
    """One row per node of the rebuilt conversations' trie: conv_id, depth, parent_conv_id, n_convs,
    n_children, n_leaves, saved_tokens, ends_sha256."""
    turns = stored(turn_rows(conversations), "trie-turns")
    seqs = stored(sequences(rebuilt(turns)), "trie-rebuilt")
    nodes = stored(trie_nodes(seqs), "trie-nodes")
    ends = ends_digests(seqs)
    none = F.lit(sha256(b"").hexdigest())
    return (with_parents(nodes).join(ends, F.col("key") == F.col("node"), "left")
            .select("conv_id", F.col("depth").cast("long").alias("depth"), "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens",
                    F.coalesce("ends", none).alias("ends_sha256")))
