"""Byte-level BPE encoding and decoding by overlapping chunks.

A long text is cut into chunks of CHUNK characters that overlap by OVERLAP.
Tasks pre-tokenise the chunks in parallel.  A chunk's first boundaries may be wrong, as it may
begin inside a pre-token; its boundaries are right from the first one that the chunk
before it has as well, since a match depends only on the text from its start on.
There the two are stitched.  Every chunk then owns the span between its two stitches,
and spans are encoded in parallel; ids and raw bytes of a document are put together in
order.  Where two chunks have no boundary in common (one pre-token as long as the
overlap), the rest of that document is one span, so results never depend on CHUNK.
Texts of at most CHUNK characters are a chunk, and a span, by themselves.

Defined cases: null text counts as empty; an empty text has no ids; null and repeated
doc_ids are rows like others; an empty table gives an empty result; columns other than
doc_id and text are ignored.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
import tiktoken
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsspark.llm.common import map_arrow, stored, utf8

RANKS = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
CHUNK, OVERLAP = 1 << 15, 1 << 10


@lru_cache(maxsize=2)
def tokenizer(path: str) -> tuple[tiktoken.Encoding, list[str], list[bytes]]:
    """The encoder, and every id as decimal text and as bytes."""
    with open(path, "rb") as f:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
    size = max(ranks.values(), default=-1) + 1
    raw = [b""] * size
    for token, rank in ranks.items():
        raw[rank] = token
    encoder = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return encoder, [str(i) for i in range(size)], raw


def boundaries(text: str) -> np.ndarray:
    """Starts of the pre-tokens."""
    return np.fromiter((m.start() for m in _pattern().finditer(text)), dtype=np.int64)


@lru_cache(maxsize=1)
def _pattern() -> regex.Pattern:
    return regex.compile(public_tokenizers.PATTERN)


def _parts(batch: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    return (batch.slice(i, rows) for i in range(0, batch.num_rows, rows))


def digest(path: str, pieces: Iterator[np.ndarray]) -> tuple[int, str, str]:
    """Count, hash of the decimal ids, hash of the decoded bytes."""
    _, decimal, raw = tokenizer(path)
    n, ids, decoded = 0, hashlib.sha256(), hashlib.sha256()
    for piece in pieces:
        own = piece.tolist()
        if own:
            ids.update((("," if n else "") + ",".join(map(decimal.__getitem__, own))).encode())
            decoded.update(b"".join(map(raw.__getitem__, own)))
            n += len(own)
    return n, ids.hexdigest(), decoded.hexdigest()


def encode(text: str, path: str = RANKS) -> np.ndarray:
    return np.array(tokenizer(path)[0].encode_ordinary(text), dtype=np.int32)


def decode(ids: np.ndarray, path: str = RANKS) -> bytes:
    return b"".join(map(tokenizer(path)[2].__getitem__, ids.tolist()))


def _chunked(chunk: int, overlap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch, 16):
                rid, k, piece = [], [], []
                for r, text in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                    for i, at in enumerate(range(0, len(text), chunk)):
                        rid.append(r)
                        k.append(i)
                        piece.append(text[at:at + chunk + overlap])
                yield pa.RecordBatch.from_arrays([pa.array(rid, pa.int64()), pa.array(k, pa.int64()), pa.array(piece, pa.string())],
                                                 names=["rid", "k", "piece"])
    return run


def _bounds(chunk: int, overlap: int):
    """Boundaries, counted from the start of the text, in a chunk's first and last OVERLAP characters."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                head, tail = [], []
                for k, text in zip(part.column(1).to_pylist(), part.column(2).to_pylist(), strict=True):
                    at = boundaries(text) + k * chunk
                    head.append(at[at < k * chunk + overlap])
                    tail.append(at[at >= (k + 1) * chunk])
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(head, pa.list_(pa.int64())),
                                                  pa.array(tail, pa.list_(pa.int64()))], names=["rid", "k", "head", "tail"])
    return run


def spans(chunks: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """Stitch: (rid, owner, k, joined, text): the pieces, in order of k, of the span of chunk ``owner``.

    ``joined`` tells the pieces of spans that have several.
    """
    bounds = map_arrow(chunks.repartition("rid", "k"), _bounds(chunk, overlap), "rid long, k long, head array<long>, tail array<long>")
    order = Window.partitionBy("rid").orderBy("k")
    stitched = bounds.withColumn("sync", F.array_min(F.array_intersect("head", F.lag("tail").over(order))))
    stitched = stitched.select("rid", "k", F.when(F.col("k") == 0, F.lit(0)).otherwise(F.col("sync")).alias("start"))
    stitched = stitched.withColumn("broken", F.max(F.col("start").isNull()).over(order))
    stitched = stitched.withColumn("owner", F.max(F.when(~F.col("broken"), F.col("k"))).over(order))
    stitched = stitched.withColumn("next", F.lead("start").over(order)).withColumn("next_broken", F.lead("broken").over(order))
    cuts = stitched.select(
        F.col("rid").alias("r"), F.col("k").alias("c"), "owner",
        # within the chunk; without a stitch to the next chunk, up to where that one begins
        F.when(F.col("broken"), F.lit(0)).otherwise(F.col("start") - F.col("k") * chunk).alias("lo"),
        F.when(F.col("next_broken").isNull(), F.lit(chunk + overlap))
        .when(F.col("next_broken"), F.lit(chunk)).otherwise(F.col("next") - F.col("k") * chunk).alias("hi"),
        (F.col("broken") | F.coalesce("next_broken", F.lit(False))).alias("joined"))
    joined = chunks.join(cuts, (F.col("rid") == F.col("r")) & (F.col("k") == F.col("c")))
    return joined.select("rid", "owner", "k", "joined",
                         F.expr("substring(piece, cast(lo + 1 as int), cast(hi - lo as int))").alias("text"))


def _encoded(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                ids = [encode(text, path).tobytes() for text in part.column(2).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(ids, pa.binary())],
                                                 names=["rid", "owner", "ids"])
    return run


def _digested(path: str, whole: bool):
    """Rows (doc_id, text), or (doc_id, ids of the spans in order), to digests."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in _parts(batch):
                done = [digest(path, [encode(x, path)] if whole else [np.frombuffer(b, dtype=np.int32) for b in x])
                        for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), pa.array([d[0] for d in done], pa.int64()), pa.array([d[1] for d in done], pa.string()),
                     pa.array([d[2] for d in done], pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
    return run


def encode_spans(chunks: DataFrame, path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(rid, owner, ids as little-endian int32) for every span."""
    pieces = stored(spans(chunks, chunk, overlap), "bpe-pieces")
    own = pieces.filter("not joined").select("rid", "owner", "text")
    in_order = F.array_sort(F.collect_list(F.struct("k", "text")))
    joined = (pieces.filter("joined").groupBy("rid", "owner").agg(in_order.alias("p"))
              .select("rid", "owner", F.array_join(F.transform("p", lambda x: x["text"]), "").alias("text")))
    return map_arrow(own.unionByName(joined), _encoded(path), "rid long, owner long, ids binary")


def chunk_texts(long_docs: DataFrame, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """(rid, k, piece) of rows (rid, text)."""
    return map_arrow(long_docs.select("rid", "text"), _chunked(chunk, overlap), "rid long, k long, piece string")


def encode_documents(docs: DataFrame, path: str = RANKS, chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256 (decimal ids joined by commas), decoded_sha256."""
    kind = docs.schema["doc_id"].dataType.simpleString()
    result = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string"
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    is_long = F.length("text") > chunk
    short = map_arrow(rows.filter(~is_long), _digested(path, whole=True), result)
    # long texts only: written once, so that row ids and chunks are fixed
    long_docs = stored(rows.filter(is_long).withColumn("rid", F.monotonically_increasing_id()), "bpe-long")
    ids = encode_spans(stored(chunk_texts(long_docs, chunk, overlap), "bpe-chunks"), path, chunk, overlap)
    ordered = F.array_sort(F.collect_list(F.struct("owner", "ids")))
    lists = (ids.groupBy("rid").agg(ordered.alias("p"))
             .select(F.col("rid").alias("r"), F.transform("p", lambda x: x["ids"]).alias("ids")))
    joined = long_docs.select("rid", "doc_id").join(lists, F.col("rid") == F.col("r")).select("doc_id", "ids")
    return short.unionByName(map_arrow(joined, _digested(path, whole=False), result))
