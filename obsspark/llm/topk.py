"""Exact top-k by inner product: columnar branch-and-bound.

Vectors are packed into blocks in vertical layout (one row of a block's matrix per
dimension).  For a block of queries and a block of candidates, products are accumulated
over DIMS dimensions at a time.  What the dimensions still to come can add is at most the
product of the two remaining norms (Cauchy-Schwarz), which bounds every score from both
sides; a candidate whose upper bound is below the k-th best lower bound, or below the k-th
best score that the task has seen so far, is out, and the survivors are compacted.  Sums
are exact: integers in double precision while all of them stay below 2**53, else
Python integers.

The stated query set meets all rows block by block; a task holds one block of each.

Defined cases: a vector that is null or empty or holds a null or non-finite component takes no part;
vectors of different lengths are not compared; ties go to the smaller vec_id (null
lowest); a row is not its own candidate, but an equal row is; scores beyond 64 bits are
set to the nearest long; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from obsspark.llm.common import map_arrow, stored

QUERIES, CANDIDATES, DIMS = 256, 2048, 16
#: share of survivors from which the accumulation goes on over compacted pairs
COMPACT = 0.3
#: candidate blocks that one task takes for a query block
BLOCKS_PER_TASK = 16
_NULL_ID = -(2 ** 63)
_BLOCK = "dim long, n long, rids binary, ids binary, vectors binary"


def _pack(rows: int):
    """Rows (rid, vec_id, long components) to blocks of ``rows`` vectors of one length."""
    def emit(dim: int, held: list) -> pa.RecordBatch:
        rid, ids, vec = (np.concatenate(x) for x in zip(*held, strict=True))
        return pa.RecordBatch.from_pydict({
            "dim": pa.array([dim], pa.int64()), "n": pa.array([len(rid)], pa.int64()), "rids": pa.array([rid.tobytes()], pa.binary()),
            "ids": pa.array([ids.tobytes()], pa.binary()), "vectors": pa.array([np.ascontiguousarray(vec.T).tobytes()], pa.binary())})

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = {}
        for batch in batches:
            for lo in range(0, batch.num_rows, rows):
                part = batch.slice(lo, rows)
                rid = part.column(0).to_numpy()
                ids = part.column(1).fill_null(_NULL_ID).to_numpy()
                lengths = part.column(2).value_lengths().to_numpy()
                flat = part.column(2).flatten().to_numpy()
                ends = np.cumsum(lengths)
                for dim in np.unique(lengths):
                    at = np.flatnonzero(lengths == dim)
                    vec = flat[(ends[at] - dim)[:, None] + np.arange(dim)]
                    own = held.setdefault(int(dim), [])
                    own.append((rid[at], ids[at], vec))
                    if sum(len(x[0]) for x in own) >= rows:
                        yield emit(int(dim), held.pop(int(dim)))
        for dim, own in held.items():
            yield emit(dim, own)
    return run


def integers(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(rid, vec_id, v): floor(256 * x) of every component, of the vectors that take part."""
    whole = F.col(vector_col)
    finite = F.forall(whole, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return (vectors.filter(whole.isNotNull() & (F.size(whole) > 0) & finite)
            .select(F.monotonically_increasing_id().alias("rid"), F.col(id_col).cast("long").alias("vec_id"),
                    F.transform(whole, lambda x: F.floor(x.cast("double") * 256).cast("long")).alias("v")))


def best_of_blocks(q: np.ndarray, c: np.ndarray, own: np.ndarray, ids: np.ndarray, k: int,
                   floor: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query index, candidate index, score) of each query's k best candidates of a block.

    ``q`` and ``c`` have a row per dimension; ``own`` marks pairs that do not count; no score
    below ``floor`` of the query is needed.
    """
    dims, exact = q.shape[0], q.dtype != object
    tail = lambda m: np.sqrt(np.concatenate([np.cumsum((m.astype(float) ** 2)[::-1], axis=0)[::-1], np.zeros((1, m.shape[1]))]))
    qt, ct = tail(q), tail(c)
    score = np.zeros((q.shape[1], c.shape[1]), dtype=q.dtype)
    pairs = None
    for lo in range(0, dims, DIMS):
        hi = min(dims, lo + DIMS)
        if pairs is None:
            score = score + q[lo:hi].T @ c[lo:hi]
            if not exact:
                continue
            rest = qt[hi][:, None] * ct[hi][None, :] * (1 + 1e-9)
            low = np.where(own, -np.inf, score - rest)
            if low.shape[1] > k:
                floor = np.maximum(floor, np.partition(low, -k, axis=1)[:, -k])
            alive = (score + rest >= floor[:, None] - 0.5) & ~own
            if hi == dims or alive.mean() < COMPACT:
                pairs = np.nonzero(alive)
                value = score[pairs]
        else:
            i, j = pairs
            value = value + np.einsum("dp,dp->p", q[lo:hi, i], c[lo:hi, j])
            keep = value + qt[hi][i] * ct[hi][j] * (1 + 1e-9) >= floor[i] - 0.5
            pairs, value = (i[keep], j[keep]), value[keep]
    if pairs is None:
        pairs = np.nonzero(~own)
        value = score[pairs]
    i, j = pairs
    order = sorted(range(len(i)), key=lambda x: (i[x], -value[x], ids[j[x]])) if not exact else np.lexsort((ids[j], -value, i))
    i, j, value = i[order], j[order], value[order]
    first = np.searchsorted(i, i)
    top = np.arange(len(i)) - first < k
    return i[top], j[top], value[top]


def _search(k: int):
    """Pairs of blocks, dealt and sorted by query block, to each query's k best of each candidate block."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, best = None, None
        for batch in batches:
            for row in range(batch.num_rows):
                r = {name: batch.column(name)[row].as_py() for name in batch.schema.names}
                q = np.frombuffer(r["qvectors"], dtype=np.int64).reshape(r["dim"], -1)
                c = np.frombuffer(r["vectors"], dtype=np.int64).reshape(r["dim"], -1)
                top = float(np.abs(q.astype(float)).max()) * float(np.abs(c.astype(float)).max()) * r["dim"]
                q, c = (q.astype(float), c.astype(float)) if top < 2 ** 52 else (q.astype(object), c.astype(object))
                qrid, rid = (np.frombuffer(r[x], dtype=np.int64) for x in ("qrids", "rids"))
                qid, ids = (np.frombuffer(r[x], dtype=np.int64) for x in ("qids", "ids"))
                if block != r["q"]:
                    block, best = r["q"], np.full((len(qrid), k), -np.inf)
                i, j, value = best_of_blocks(q, c, qrid[:, None] == rid[None, :], ids, k, best.min(axis=1))
                seen = np.full((len(qrid), k), -np.inf)
                seen[i, np.arange(len(i)) - np.searchsorted(i, i)] = value.astype(float)
                best = np.sort(np.concatenate([best, seen], axis=1), axis=1)[:, -k:]
                whole = np.array([min(max(int(x), -(2 ** 63)), 2 ** 63 - 1) for x in value], dtype=np.int64)
                yield pa.RecordBatch.from_pydict({"qrid": pa.array(qrid[i]), "query_id": pa.array(qid[i]),
                                                  "vec_id": pa.array(ids[j]), "score": pa.array(whole)})
    return run


def top_k(vectors: DataFrame, is_query: Column, k: int = 5) -> DataFrame:
    """query_id, rank, vec_id, score of each query row's k best other rows; ``is_query`` is on vec_id."""
    rows = stored(integers(vectors), "topk-rows")
    kind = lambda n: stored(map_arrow(rows.filter(is_query) if n == QUERIES else rows, _pack(n), _BLOCK)
                            .withColumn("block", F.monotonically_increasing_id()), "topk-blocks")
    queries, candidates = kind(QUERIES), kind(CANDIDATES)
    listed = queries.select(F.col("dim").alias("qdim"), F.col("block").alias("q"))
    # one row per pair of blocks of one length: the block numbers first, the blocks after
    pairs = candidates.select("dim", F.col("block").alias("c")).join(F.broadcast(listed) if listed.count() <= 10_000 else listed,
                                                                     F.col("dim") == F.col("qdim")).select("q", "c")
    pairs = (pairs.join(candidates, F.col("c") == F.col("block")).drop("block", "n")
             .join(queries.select(F.col("block").alias("qblock"), F.col("rids").alias("qrids"), F.col("ids").alias("qids"),
                                  F.col("vectors").alias("qvectors")), F.col("q") == F.col("qblock")).drop("qblock"))
    tasks = max(1, candidates.count() // BLOCKS_PER_TASK)
    dealt = pairs.withColumn("part", F.pmod(F.xxhash64("c"), F.lit(tasks))).repartition("q", "part").sortWithinPartitions("q", "part")
    found = map_arrow(dealt, _search(k), "qrid long, query_id long, vec_id long, score long")
    null = lambda c: F.when(F.col(c) != _NULL_ID, F.col(c)).alias(c)
    rank = F.row_number().over(Window.partitionBy("qrid").orderBy(F.desc("score"), F.asc("vec_id")))
    return found.withColumn("rank", rank).filter(F.col("rank") <= k).select(null("query_id"), "rank", null("vec_id"), "score")
