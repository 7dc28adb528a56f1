"""Language ID: multinomial naive Bayes over hashed character n-grams.

Training counts the n-grams (1 to 3 code points of the lower-cased text, hashed
into BUCKETS) of a bounded sample of labelled documents per language; every task adds up
its own matrix, so that only languages x BUCKETS counts are shuffled and collected.
The matrix of log-probabilities (BUCKETS x languages, float32) is broadcast; its size
depends on the number of languages alone.  Scoring gathers the matrix rows of a
block of texts and sums them per text with numpy.

Defined cases: a text that is null or has no letter gets ``und`` with score 0, as does
every text when there is nothing to learn from; equal scores go to the smallest language by
code point; a null lang is not learned from; a null doc_id counts as not held out;
other columns are passed through, also such as are named like results.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from obsspark.llm.common import map_arrow

#: hash buckets of n-grams
BUCKETS = 1 << 15
#: expected number of labelled documents learned from, at most (chosen by hash)
TRAIN_DOCS = 40_000
#: code points handled at once
BLOCK_CHARS = 1 << 17
#: languages whose counts a task holds before it passes them on
HELD_LANGS = 64
SMOOTHING = 0.1
PRED, SCORE = "_lang_pred", "_lang_score"

_LETTER = regex.compile(r"\p{L}")
_FACTORS = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D], dtype=np.uint32)


def fold(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; 2 is held out."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def _codes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    lowered = [t.lower() for t in texts]
    codes = np.frombuffer("".join(lowered).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    return codes, np.cumsum([0, *map(len, lowered)])


def _grams(codes: np.ndarray, offsets: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Buckets of the n-grams inside texts; offsets of each text's n-grams."""
    value = np.full(max(0, len(codes) - n + 1), n, dtype=np.uint32)
    for k in range(n):
        value = (value ^ codes[k:len(codes) - n + 1 + k]) * _FACTORS[k]
        value ^= value >> np.uint32(15)
    value = (value * np.uint32(0x27D4EB2F)) >> np.uint32(17)
    sizes = np.maximum(np.diff(offsets) - (n - 1), 0)
    inside = np.ones(len(value), dtype=bool)
    for k in range(1, n):  # n-grams that reach into the next text
        ends = offsets[1:-1] - k
        inside[ends[(ends >= 0) & (ends < len(value))]] = False
    out = value[inside]
    return out, np.concatenate([[0], np.cumsum(sizes)])


def _blocks(texts: list[str]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > BLOCK_CHARS:
            yield lo, i
            lo, size = i, 0
        size += len(t)
    if lo < len(texts):
        yield lo, len(texts)


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, np.ndarray] = {}

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, counts in held.items():
            at = np.flatnonzero(counts)
            if len(at):
                yield pa.RecordBatch.from_pydict({"lang": pa.array([lang] * len(at), pa.string()),
                                                  "bucket": pa.array(at.astype(np.int32)), "n": pa.array(counts[at])})
        held.clear()

    for batch in batches:
        for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
            by: dict[str, list[str]] = {}
            for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist(), strict=True):
                by.setdefault(lang, []).append(text)
            for lang, texts in by.items():
                if lang not in held and len(held) >= HELD_LANGS:
                    yield from flush()
                counts = held.setdefault(lang, np.zeros(BUCKETS, dtype=np.int64))
                for lo, hi in _blocks(texts):
                    codes, offsets = _codes(texts[lo:hi])
                    for n in (1, 2, 3):
                        counts += np.bincount(_grams(codes, offsets, n)[0], minlength=BUCKETS)
    yield from flush()


@dataclass(frozen=True)
class Model:
    langs: tuple[str, ...]
    #: BUCKETS x languages
    log_prob: np.ndarray


def train(labelled: DataFrame, max_docs: int = TRAIN_DOCS) -> Model:
    """Learn from (doc_id, text, lang); ``max_docs`` bounds the expected sample, chosen by hash."""
    rows = labelled.filter(F.col("lang").isNotNull() & F.col("text").isNotNull()).select("doc_id", "text", "lang")
    total = rows.count()
    if total > max_docs:
        draw = F.shiftrightunsigned(F.xxhash64(F.lit("language-id"), F.col("doc_id")), 1) / F.lit(float(1 << 63))
        rows = rows.filter(draw < max_docs / total)
    counts = (map_arrow(rows.select("text", "lang"), _count, "lang string, bucket int, n long")
              .groupBy("lang", "bucket").agg(F.sum("n").alias("n")).collect())
    langs = tuple(sorted({r.lang for r in counts}))
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    place = {lang: i for i, lang in enumerate(langs)}
    for lang, bucket, n in counts:
        table[bucket, place[lang]] += n
    return Model(langs, np.log(table / table.sum(axis=0, keepdims=True)).astype(np.float32))


def score_texts(model: Model, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
    """Language and posterior probability of each text."""
    pred, score = ["und"] * len(texts), np.zeros(len(texts))
    able = [i for i, t in enumerate(texts) if model.langs and t is not None and _LETTER.search(t)]
    for lo, hi in _blocks([texts[i] for i in able]):
        rows = able[lo:hi]
        codes, offsets = _codes([texts[i] for i in rows])
        like = np.zeros((len(rows), len(model.langs)))
        for n in (1, 2, 3):
            buckets, at = _grams(codes, offsets, n)
            some = np.flatnonzero(np.diff(at) > 0)
            if len(some):
                for k in range(len(model.langs)):
                    like[some, k] += np.add.reduceat(model.log_prob[buckets, k], at[some], dtype=np.float64)
        best = like.argmax(axis=1)
        share = np.exp(like - like.max(axis=1, keepdims=True))
        share = share[np.arange(len(rows)), best] / share.sum(axis=1)
        for i, b, s in zip(rows, best, share, strict=True):
            pred[i], score[i] = model.langs[b], s
    return pred, score


def predict(docs: DataFrame, model: Model) -> DataFrame:
    """The documents with two more columns, PRED and SCORE."""
    shared = docs.sparkSession.sparkContext.broadcast((model.langs, model.log_prob))
    place = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Model(*shared.value)
        for batch in batches:
            for part in (batch.slice(i, 512) for i in range(0, batch.num_rows, 512)):
                pred, score = score_texts(own, part.column(place).to_pylist())
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(pred, pa.string()), pa.array(score)],
                                                 names=[*part.schema.names, PRED, SCORE])

    schema = T.StructType([*docs.schema.fields, T.StructField(PRED, T.StringType()), T.StructField(SCORE, T.DoubleType())])
    return map_arrow(docs, run, schema)


def language_id(docs: DataFrame, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """One row per document: doc_id, held_out, lang_pred, score."""
    model = train(docs.filter(fold(F.col("doc_id")) != 2), max_docs)
    rows = docs.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "text")
    return predict(rows, model).select("doc_id", "held_out", F.col(PRED).alias("lang_pred"), F.col(SCORE).alias("score"))


def keep_identified(docs: DataFrame, min_score: float = 0.5, max_docs: int = TRAIN_DOCS) -> DataFrame:
    """The documents whose language is told with ``min_score`` at least, columns as they came."""
    model = train(docs.filter(fold(F.col("doc_id")) != 2), max_docs)
    return predict(docs, model).filter((F.col(PRED) != "und") & (F.col(SCORE) >= min_score)).select(docs.columns)
