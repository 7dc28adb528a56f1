"""MinHash near-dedup by an LSH forest, links confirmed on full shingle sets.

1. One scan of the texts writes a signature table: set size, fingerprint and
   TREES * DEPTH minima per document.  Documents with equal sets are one class from
   here on; of a class, one row goes on.
2. Forest: in each tree a class has a key of DEPTH minima.  Classes that share the first
   BASE minima of a key are a region.  A region with more than REGION classes
   is taken one minimum deeper, on and on (adaptive depth); one that is still too large at
   full depth, where its members are near copies of each other, is dealt into parts that
   all hold its first member.  That finds most links of such regions, not all; step 4 does.
3. Within regions, neighbours are compared by their whole signatures.  Sure pairs are
   thinned to a spanning forest and confirmed on full sets; confirmed links give
   components.  Then all pairs of different components with an estimate of
   LEAST or more are confirmed on full sets inside the region (a pair that shares several
   regions in that of the first tree), so that no link is lost that would join two
   components, and pairs within a large group are never listed.
4. Classes of regions that were too large at BASE minima are joined once more, exactly:
   two sets that link share a shingle among the first quarter of each, in one order of
   all shingles, common ones last.  Classes of different components that share such a
   shingle, and whose sets can still overlap enough from there on, are confirmed on full
   sets.  A shingle of many classes is dealt into pairs of blocks of at most BLOCK.
5. Components over the confirmed links; the smallest doc_id is the component's.

A pair of similarity 0.75 shares a region of BASE minima in some tree with a
probability of 1 - 2e-6, and an estimate below LEAST has one of 1e-4; where all its
regions are too large, step 4 finds it for sure.

Defined cases: null text, empty text and text without words have no shingles and are
linked with nothing; equal rows are one class; a null doc_id is never a
component_id unless the class has no other, and such a row counts as kept; an empty table gives an
empty result; columns other than doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from obsspark.llm.common import map_arrow, maybe_in, membership_filter, scratch, small_join, stored, utf8
from obsspark.llm.graph import components
from obsspark.llm.lsh_forest import DEPTH, TREES, exact_links, fingerprints, signatures, similar_pairs, spanning_forest
from obsspark.llm.shingles import shingle_sets

#: words of a shingle; links need 100 * intersection >= PERCENT * union
WIDTH, PERCENT = 5, 75
#: minima that all members of a region share at least; members from which it goes deeper
BASE, REGION = 2, 2048
#: estimates from which a pair is sure enough for the spanning forest, and worth confirming
SURE, LEAST = 0.8, 0.6
#: trees whose sure pairs are confirmed first
FIRST_TREES = 4
#: classes that share a shingle and are compared at once; shingles that are put last as common, at most
BLOCK, COMMON = 1024, 100_000

_ID = ["rid", "doc_id", "dk"]


def document_key(doc_id: Column, text: Column) -> Column:
    return F.xxhash64(doc_id, utf8(text))


def _parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def _texts(column: pa.ChunkedArray | pa.Array) -> list[bytes]:
    return [t or b"" for t in column.cast(pa.binary()).to_pylist()]


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            n, f1, f2, sig = [], [], [], []
            for _, offsets, hashes in shingle_sets(_texts(part.column("text")), WIDTH):
                n.append(np.diff(offsets))
                a, b = fingerprints(offsets, hashes)
                f1.append(a)
                f2.append(b)
                sig += [row.tobytes() for row in signatures(offsets, hashes).astype(">u4")]
            yield pa.RecordBatch.from_arrays(
                [*(part.column(c) for c in _ID), pa.array(np.concatenate(n).astype(np.int64)), pa.array(np.concatenate(f1)),
                 pa.array(np.concatenate(f2)), pa.array(sig, pa.binary())], names=[*_ID, "n", "f1", "f2", "sig"])


def signature_table(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select(F.monotonically_increasing_id().alias("rid"), F.col("doc_id"),
                       document_key(F.col("doc_id"), F.col("text")).alias("dk"), utf8(F.col("text")).alias("text"))
    return stored(map_arrow(rows, _signed, f"rid long, doc_id {kind}, dk long, n long, f1 long, f2 long, sig binary"), "near-signatures")


def region_key(depth: int) -> Column:
    """Key of the region of row (sig, tree) at ``depth``; the minima are big-endian."""
    return F.xxhash64("tree", F.expr(f"substring(sig, tree * {4 * DEPTH} + 1, {4 * depth})"))


def regions(reps: DataFrame, region: int = REGION) -> tuple[DataFrame, DataFrame | None]:
    """(cid, tree, key) of the classes that share a region with another one; the cids of regions too large at BASE."""
    crowded = None
    keyed = reps.select("cid", F.explode(F.array(*[F.struct(
        F.lit(t).alias("tree"), F.xxhash64(F.lit(t), F.substring("sig", t * 4 * DEPTH + 1, 4 * BASE)).alias("key"))
        for t in range(TREES)])).alias("x")).select("cid", "x.tree", "x.key")
    found = []
    for depth in range(BASE, DEPTH + 1):
        counts = stored(keyed.groupBy("key").agg(F.count(F.lit(1)).alias("m"), F.min("cid").alias("first")).filter("m > 1")
                        .withColumnRenamed("key", "k"), "near-regions")
        members = keyed.join(counts, F.col("key") == F.col("k")).drop("k")
        found.append(members.filter(F.col("m") <= region).select("cid", "tree", "key"))
        large = counts.filter(F.col("m") > region)
        if large.isEmpty():
            break
        members = stored(members.filter(F.col("m") > region), "near-large")
        if crowded is None:
            crowded = stored(members.select("cid").distinct(), "near-crowded")
        if depth < DEPTH:
            keyed = (members.select("cid", "tree").join(reps.select(F.col("cid").alias("c"), "sig"), F.col("cid") == F.col("c"))
                     .select("cid", "tree", region_key(depth + 1).alias("key")))
        else:
            size = F.ceil(F.col("m") / region).cast("int")
            own = F.pmod(F.xxhash64("cid", F.lit("part")), size)
            part = F.explode(F.when(F.col("cid") == F.col("first"), F.sequence(F.lit(0).cast("long"), size - 1)).otherwise(F.array(own)))
            found.append(members.withColumn("part", part).select("cid", "tree", F.xxhash64("key", "part").alias("key")))
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return stored(out, "near-members"), crowded


def region_rows(members: DataFrame, reps: DataFrame) -> DataFrame:
    """(key, tree, cid, n, sig, keys): a row per membership; keys are a class's regions by tree."""
    by_class = members.groupBy("cid").agg(F.collect_list(F.struct("tree", "key")).alias("own"))
    joined = reps.select(F.col("cid").alias("c"), "n", "sig").join(by_class, F.col("c") == F.col("cid"))
    return joined.select("cid", "n", "sig", F.col("own.tree").alias("trees"), F.col("own.key").alias("keys"),
                         F.explode("own").alias("at")).select("at.key", "at.tree", "cid", "n", "sig", "trees", "keys")


def by_region(rows: DataFrame) -> DataFrame:
    return rows.repartition("key").sortWithinPartitions("key", "cid")


def _whole_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Batches dealt and sorted by key (first column), cut where a region ends."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        key = batch.column(0).to_numpy(zero_copy_only=False)
        last = int(np.searchsorted(key, key[-1]))  # keys are sorted within a task
        if held and (last or held[-1].column(0)[0].as_py() != key[0]):
            held.append(batch.slice(0, last))
            yield pa.Table.from_batches(held)
            held = []
        elif last:
            yield pa.Table.from_batches([batch.slice(0, last)])
        held.append(batch.slice(last))
    if held:
        yield pa.Table.from_batches(held)


def _matrix(column: pa.ChunkedArray) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), dtype=np.uint32).reshape(len(column), TREES * DEPTH)


def _key_matrix(table: pa.Table) -> np.ndarray:
    out = np.zeros((table.num_rows, TREES), dtype=np.int64)
    for row, (trees, keys) in enumerate(zip(table.column("trees").to_pylist(), table.column("keys").to_pylist(), strict=True)):
        out[row, trees] = keys
    return out


def _numbers(table: pa.Table, name: str) -> np.ndarray:
    return table.column(name).to_numpy()


def _first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sure links (a, b) of the first trees, thinned; classes (a, null) with a pair worth confirming."""
    for table in _whole_regions(batches):
        key, tree, cid, n = (_numbers(table, c) for c in ("key", "tree", "cid", "n"))
        sig = _matrix(table.column("sig"))
        i, j, est = similar_pairs(key, n, sig, LEAST, tree=np.where(tree < FIRST_TREES, 0, tree), keys=_key_matrix(table))
        sure = (est >= SURE) & (tree[i] < FIRST_TREES)
        edges, _ = spanning_forest(len(key), i[sure], j[sure], est[sure])
        a, b = cid[i[sure][edges]], cid[j[sure][edges]]
        alone = np.unique(np.concatenate([cid[i], cid[j]]))
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.concatenate([np.minimum(a, b), alone])),
             pa.concat_arrays([pa.array(np.maximum(a, b), pa.int64()), pa.nulls(len(alone), pa.int64())])], names=["a", "b"])


def _second_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, cid) that have a pair of different components worth confirming in this region."""
    for table in _whole_regions(batches):
        key, tree, cid, n, comp = (_numbers(table, c) for c in ("key", "tree", "cid", "n", "comp"))
        i, j, _ = similar_pairs(key, n, _matrix(table.column("sig")), LEAST, comp=comp, tree=tree, keys=_key_matrix(table))
        at = np.unique(np.concatenate([i, j]))
        yield pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(cid[at]), pa.array(comp[at])], names=["key", "cid", "comp"])


def _confirm(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (a, b, set of a, set of b) that are links."""
    for batch in batches:
        for part in _parts(batch):
            keep = []
            for x, y in zip(part.column(2).to_pylist(), part.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, dtype=np.uint64), np.frombuffer(y, dtype=np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                keep.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            chosen = part.select([0, 1]).filter(pa.array(keep, pa.bool_()))
            yield pa.RecordBatch.from_arrays(chosen.columns, names=["a", "b"])


def _confirm_regions(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links between different components inside each region, thinned to spanning forests."""
    for table in _whole_regions(batches):
        key, cid, comp = (_numbers(table, c) for c in ("key", "cid", "comp"))
        sets = [np.frombuffer(x, dtype=np.uint64) for x in table.column("hashes").to_pylist()]
        i, j = exact_links(key, comp, sets, PERCENT)
        edges, _ = spanning_forest(len(key), i, j, np.ones(len(i)))
        yield pa.RecordBatch.from_arrays([pa.array(cid[i[edges]]), pa.array(cid[j[edges]])], names=["a", "b"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            out = []
            for _, offsets, hashes in shingle_sets(_texts(part.column(1)), WIDTH):
                out += [hashes[offsets[k]:offsets[k + 1]].tobytes() for k in range(len(offsets) - 1)]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(out, pa.binary())], names=["dk", "hashes"])


def full_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(cid, hashes) of the classes in ``wanted`` (cid, dk): a second scan, of the rows with these keys."""
    key = document_key(F.col("doc_id"), F.col("text"))
    rows = maybe_in(docs.select(key.alias("dk"), utf8(F.col("text")).alias("text")), F.col("dk"), membership_filter(wanted, "dk"))
    sets = map_arrow(rows.filter("_maybe").select("dk", "text"), _sets, "dk long, hashes binary")
    wanted = wanted.withColumnRenamed("dk", "w")
    return stored(wanted.join(sets, F.col("w") == F.col("dk")).select("cid", "hashes").dropDuplicates(["cid"]), "near-sets")


def _shingle_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part in _parts(batch):
            shingle, count = np.unique(np.frombuffer(b"".join(part.column(0).to_pylist()), dtype=np.int64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(count)], names=["shingle", "m"])


def _prefixes(common: np.ndarray, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(shingle, cid, comp, n, left): the first shingles of each set by the order of step 4; ``left`` come from there on."""
    at = np.argsort(common)
    ordered = common[at]
    for batch in batches:
        for part in _parts(batch):
            cids, comps = (part.column(c).to_numpy() for c in ("cid", "comp"))
            shingles, row, n, left = [], [], [], []
            for k, raw in enumerate(part.column("hashes").to_pylist()):
                own = np.frombuffer(raw, dtype=np.int64)
                place = np.zeros(len(own), dtype=np.int64)  # 0 for all that are not common
                if len(ordered):
                    found = np.minimum(np.searchsorted(ordered, own), len(ordered) - 1)
                    place = np.where(ordered[found] == own, at[found] + 1, 0)
                first = len(own) + 1 + (-PERCENT * len(own)) // 100  # one more than a linked set can lack
                shingles.append(own[np.lexsort((own, place))[:first]])
                row.append(np.full(first, k))
                n.append(np.full(first, len(own)))
                left.append(len(own) - np.arange(first))
            row = np.concatenate(row)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(shingles)), pa.array(cids[row]), pa.array(comps[row]), pa.array(np.concatenate(n)),
                 pa.array(np.concatenate(left))], names=["shingle", "cid", "comp", "n", "left"])


def _prefix_pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(a, b) of different components that share the key's shingle and may be links if it is the first they share."""
    for table in _whole_regions(batches):
        key, cid, comp, n, left, block = (_numbers(table, c) for c in ("key", "cid", "comp", "n", "left", "block"))
        starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
        for lo, hi in zip(starts, np.append(starts[1:], len(key)), strict=True):
            across = block[lo:hi].min() != block[lo:hi].max()  # pairs inside a block have a key of their own
            out_a, out_b = [], []
            for i in range(lo, hi - 1):
                j = np.arange(i + 1, hi)
                # 100 * both >= PERCENT * (n + n - both), and both is at most what is left of either
                ok = (comp[j] != comp[i]) & ((100 + PERCENT) * np.minimum(left[j], left[i]) >= PERCENT * (n[j] + n[i]))
                if across:
                    ok &= block[j] != block[i]
                out_b.append(cid[j[ok]])
                out_a.append(np.full(len(out_b[-1]), cid[i]))
            if not out_a:
                continue
            a, b = np.concatenate(out_a), np.concatenate(out_b)
            for x in range(0, len(a), 1 << 16):
                u, v = a[x:x + (1 << 16)], b[x:x + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(u, v)), pa.array(np.maximum(u, v))], names=["a", "b"])


def _blocks(heavy: DataFrame, block: int) -> DataFrame:
    """Rows of shingles with more than ``block`` classes, each for all pairs of blocks that its block is in.

    A component with more than a block has blocks of its own, the others share some; no
    pair is made of blocks of one component.
    """
    per = stored(heavy.groupBy("shingle", "comp").agg(F.count(F.lit(1)).alias("k")), "near-heavy")
    own = F.col("k") > block
    plan = per.groupBy("shingle").agg(
        F.ceil(F.sum(F.when(own, 0).otherwise(F.col("k"))) / block).alias("pool"),
        F.collect_list(F.when(own, F.struct("comp", F.ceil(F.col("k") / block).alias("parts")))).alias("large"))
    whose = F.flatten(F.transform("large", lambda x: F.transform(
        F.sequence(F.lit(0).cast("long"), x["parts"] - 1), lambda i: F.struct(x["comp"].alias("owner"), i.alias("i")))))
    shared = F.when(F.col("pool") > 0, F.transform(F.sequence(F.lit(0).cast("long"), F.col("pool") - 1), lambda i: F.struct(
        F.lit(None).cast("long").alias("owner"), i.alias("i")))).otherwise(F.array().cast("array<struct<owner:bigint,i:bigint>>"))
    plan = stored(plan.select(F.col("shingle").alias("s"), "pool", "large", F.concat(shared, whose).alias("all")), "near-blocks")
    rows = small_join(heavy, plan, F.col("shingle") == F.col("s"), "inner", plan.count())
    mine = F.filter("large", lambda x: x["comp"] == F.col("comp"))
    rows = rows.withColumn("owner", F.when(F.size(mine) > 0, F.col("comp")))
    rows = rows.withColumn("i", F.pmod(F.xxhash64("cid", F.lit("block")), F.when(F.size(mine) > 0, F.try_element_at(mine, F.lit(1))["parts"]).otherwise(F.col("pool"))))
    rows = rows.withColumn("block", F.xxhash64("shingle", F.coalesce("owner", F.lit(0)), F.col("owner").isNull(), "i"))
    rows = rows.withColumn("other", F.explode(F.filter("all", lambda x: F.col("owner").isNull() | ~x["owner"].eqNullSafe(F.col("owner")))))
    other = F.xxhash64("shingle", F.coalesce(F.col("other.owner"), F.lit(0)), F.col("other.owner").isNull(), "other.i")
    return rows.select(F.xxhash64("shingle", F.least("block", other), F.greatest("block", other)).alias("key"), "cid", "comp", "n", "left", "block")


def crowded_pairs(sets: DataFrame, block: int = BLOCK) -> DataFrame:
    """Pairs (a, b) of ``sets`` (cid, comp, hashes) of different components: all that are links, and few others."""
    counts = map_arrow(sets.select("hashes"), _shingle_counts, "shingle long, m long").groupBy("shingle").agg(F.sum("m").alias("m"))
    # the order only has to be the same for all; the rarer the first shingles, the fewer pairs
    often = counts.filter("m > 2").orderBy(F.desc("m"), "shingle").limit(COMMON).collect()
    common = np.array([r.shingle for r in reversed(often)], dtype=np.int64)
    first = stored(map_arrow(sets.select("cid", "comp", "hashes"), partial(_prefixes, common),
                             "shingle long, cid long, comp long, n long, left long"), "near-prefixes")
    live = stored(first.groupBy("shingle").agg(F.count(F.lit(1)).alias("m"), F.min("comp").alias("low"), F.max("comp").alias("high"))
                  .filter("low < high").select(F.col("shingle").alias("s"), "m"), "near-live")
    light, heavy = live.filter(F.col("m") <= block), stored(live.filter(F.col("m") > block).select("s"), "near-common")
    few = maybe_in(first, F.col("shingle"), membership_filter(light, "s")).filter("_maybe").join(light, F.col("shingle") == F.col("s"))
    rows = few.select(F.col("shingle").alias("key"), "cid", "comp", "n", "left", F.lit(0).cast("long").alias("block"))
    if not heavy.isEmpty():
        many = small_join(first, heavy, F.col("shingle") == F.col("s"), "inner", heavy.count()).drop("s")
        rows = rows.unionByName(_blocks(stored(many, "near-many"), block))
    return stored(map_arrow(by_region(rows), _prefix_pairs, "a long, b long").distinct(), "near-pairs")


def _links(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) that are links by their full sets."""
    right = sets.select(F.col("cid").alias("c2"), F.col("hashes").alias("y"))
    left = sets.select(F.col("cid").alias("c1"), F.col("hashes").alias("x"))
    pairs = pairs.join(right, F.col("b") == F.col("c2")).join(left, F.col("a") == F.col("c1")).select("a", "b", "x", "y")
    return stored(map_arrow(pairs, _confirm, "a long, b long"), "near-links")


def confirmed_links(docs: DataFrame, reps: DataFrame, region: int = REGION) -> DataFrame:
    """Links (a, b) between classes that connect all classes that any links connect."""
    members, crowded = regions(reps, region)
    rows = stored(region_rows(members, reps), "near-region-rows")
    looked = stored(map_arrow(by_region(rows), _first_look, "a long, b long").distinct(), "near-first-look")
    flagged = looked.filter("b is null").select("a")
    wanted = flagged if crowded is None else flagged.unionByName(crowded.select(F.col("cid").alias("a"))).distinct()
    sets = full_sets(docs, reps.select("cid", "dk").join(wanted, F.col("cid") == F.col("a"), "left_semi"))
    links = _links(looked.filter("b is not null"), sets)
    comps = components(links)
    # pairs between components, where a region still has more than one
    live = (rows.join(flagged, F.col("cid") == F.col("a"), "left_semi")
            .join(comps, F.col("cid") == F.col("node"), "left")
            .select(*rows.columns, F.coalesce("root", "cid").alias("comp")))
    open_ = stored(map_arrow(by_region(live), _second_look, "key long, cid long, comp long"), "near-open")
    exact = open_.join(sets.withColumnRenamed("cid", "c"), F.col("cid") == F.col("c")).select("key", "cid", "comp", "hashes")
    links = links.unionByName(map_arrow(by_region(exact), _confirm_regions, "a long, b long"))
    if crowded is None:
        return links
    links = stored(links, "near-links")
    some = sets.join(crowded.withColumnRenamed("cid", "c"), F.col("cid") == F.col("c"), "left_semi")
    some = some.join(components(links), F.col("cid") == F.col("node"), "left").select("cid", F.coalesce("root", "cid").alias("comp"), "hashes")
    return links.unionByName(_links(crowded_pairs(stored(some, "near-crowded-sets")), sets))


def near_duplicates(docs: DataFrame, region: int = REGION) -> DataFrame:
    """One row per document: doc_id, dk, n_shingles, component_id, kept; ``group`` tells components apart, also of null ids."""
    table = signature_table(docs)
    classes = stored(table.filter("n > 0").groupBy("f1", "f2", "n")
                     .agg(F.min("doc_id").alias("least"), F.min("rid").alias("rep")), "near-classes")
    reps = stored(table.join(classes.select("rep"), F.col("rid") == F.col("rep"))
                  .select(F.xxhash64("rid").alias("cid"), "dk", "n", "sig"), "near-reps")
    comps = components(confirmed_links(docs, reps, region))
    named = classes.select("f1", "f2", "n", "least", F.xxhash64("rep").alias("cid"))
    linked = stored(named.join(comps, F.col("cid") == F.col("node")).select("f1", "f2", "n", "least", "root"), "near-linked")
    lowest = linked.groupBy("root").agg(F.min("least").alias("lowest")).withColumnRenamed("root", "r")
    linked = linked.join(lowest, F.col("root") == F.col("r")).select("f1", "f2", "n", "lowest", "root")
    labels = (named.join(linked, ["f1", "f2", "n"], "left")
              .select(F.col("f1").alias("g1"), F.col("f2").alias("g2"), F.col("n").alias("gn"),
                      F.coalesce("lowest", "least").alias("component_id"), F.coalesce("root", "cid").alias("group")))
    own = table.select("doc_id", "dk", "n", "f1", "f2")
    joined = own.join(labels, (F.col("f1") == F.col("g1")) & (F.col("f2") == F.col("g2")) & (F.col("n") == F.col("gn")), "left")
    component = F.when(F.col("n") == 0, F.col("doc_id")).otherwise(F.col("component_id"))
    return joined.select("doc_id", "dk", F.col("n").alias("n_shingles"), component.alias("component_id"),
                         (F.col("doc_id").isNull() | (F.col("doc_id") == component)).alias("kept"), "group")


def drop_near_duplicates(docs: DataFrame, region: int = REGION) -> DataFrame:
    """One document of each component, all columns as they came: the one with the smallest
    doc_id, or, where no document of a component has one, that with the smallest key of its text.

    Rows that surely go nowhere pass without a shuffle; only those that may go are joined.
    """
    with scratch(docs.sparkSession):
        found = stored(near_duplicates(docs, region).filter("not kept or (doc_id is null and n_shingles > 0)")
                       .select("dk", "kept", "component_id", "group").distinct(), "near-found")
        # of rows without an id only those stay in whose component no row has one, one of each component
        unnamed = found.filter("kept and component_id is null")
        first = unnamed.groupBy("group").agg(F.min("dk").alias("_first")).withColumnRenamed("group", "_group")
        others = unnamed.join(first, F.col("group") == F.col("_group")).filter(F.col("dk") != F.col("_first")).select("dk")
        every = found.filter("not kept or component_id is not null").select("dk").unionByName(others)
        gone = stored(every.select(F.col("dk").alias("_gone")).distinct(), "near-gone", keep=True)
    flagged = maybe_in(docs.withColumn("_dk", document_key(F.col("doc_id"), F.col("text"))), F.col("_dk"), membership_filter(gone, "_gone"))
    stay = flagged.filter("not _maybe").select(docs.columns)
    unsure = flagged.filter("_maybe").join(gone, F.col("_dk") == F.col("_gone"), "left_anti").select(docs.columns)
    return stay.unionByName(unsure)
