"""Quality classifier: a generalised additive model with pairwise interactions.

One scan of the texts writes a narrow feature table.  The model is fitted on a bounded sample of
labelled rows (TRAIN_ROWS, chosen by hash): features are cut into bins at quantiles, and
cyclic boosting goes round the features, each time fitting a shallow tree over the bins of one
feature to the loss's gradient and adding a little of it to that feature's lookup table; then
the same for the pairs of features that explain most of what is left.  A score is the sum
of bin lookups, made for whole batches with numpy.

Defined cases: null text counts as empty, and an empty text gets a score like any other;
labels that are null or without a document are not learned from, documents without a
label are only scored; a null doc_id counts as not held out; of repeated labels each row
counts; without labels every score is 0.5; an empty table gives an empty result; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from obsspark.llm.common import map_arrow, stored, utf8
from obsspark.llm.language_id import fold
from obsspark.llm.shingles import word_hashes

FEATURES = ("log_words", "mean_word", "distinct_words", "repeated_neighbours", "top_word", "upper", "digits", "marks", "symbols",
            "bars", "blanks", "log_lines", "repeated_lines")
#: expected number of labelled rows that the model is fitted on, at most
TRAIN_ROWS = 20_000
BINS, PAIR_BINS, PAIRS = 48, 10, 8
ROUNDS, PAIR_ROUNDS, RATE, LEAVES, RIDGE = 150, 60, 0.15, 3, 5.0
BLOCK_BYTES = 1 << 18
_CLASSES = {"upper": b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", "digits": b"0123456789", "marks": b".,;:!?'\"()-", "symbols": b"#$%&*+/<=>@[]\\^_`{}~",
            "bars": b"|", "blanks": b" \t\n\r\x0b\x0c"}


def _class_tables() -> dict[str, np.ndarray]:
    out = {}
    for name, chars in _CLASSES.items():
        out[name] = np.zeros(256, dtype=np.int64)
        out[name][list(chars)] = 1
    return out


_TABLES = _class_tables()


def _longest_runs(doc: np.ndarray, value: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct values per document and the count of the most frequent one."""
    distinct, most = np.zeros(n), np.zeros(n)
    if len(value):
        order = np.lexsort((value, doc))
        d, v = doc[order], value[order]
        start = np.flatnonzero(np.concatenate([[True], (v[1:] != v[:-1]) | (d[1:] != d[:-1])]))
        size = np.diff(np.append(start, len(v)))
        np.add.at(distinct, d[start], 1)
        np.maximum.at(most, d[start], size)
    return distinct, most


def features(texts: list[bytes]) -> np.ndarray:
    """One row of FEATURES per text."""
    n = len(texts)
    raw = np.frombuffer(b"\n".join(texts) + b"\n", dtype=np.uint8)
    cuts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in texts])])
    size = np.maximum(np.diff(cuts) - 1, 0)
    some = np.maximum(size, 1)
    share = {}
    for name, table in _TABLES.items():
        total = np.concatenate([[0], np.cumsum(table[raw])])
        share[name] = total[cuts[1:] - 1] - total[cuts[:-1]]
    blank = np.concatenate([[True], _TABLES["blanks"][raw].astype(bool)])
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    words = word_hashes(raw.tobytes())
    doc = np.searchsorted(cuts, starts, side="right") - 1
    count = np.bincount(doc, minlength=n).astype(float)
    distinct, most = _longest_runs(doc, words, n)
    same = np.zeros(n)
    if len(words) > 1:
        again = (words[1:] == words[:-1]) & (doc[1:] == doc[:-1])
        same = np.bincount(doc[1:][again], minlength=n).astype(float)
    line_doc, line_hash = [], []
    for i, t in enumerate(texts):
        lines = [x for x in t.split(b"\n") if x.strip()]
        line_doc += [i] * len(lines)
        line_hash += [hash(x) for x in lines]  # compared within this call only
    lines = np.bincount(np.array(line_doc, dtype=np.int64), minlength=n).astype(float)
    distinct_lines, _ = _longest_runs(np.array(line_doc, dtype=np.int64), np.array(line_hash, dtype=np.int64), n)
    wide = np.maximum(count, 1)
    return np.stack([
        np.log1p(count), (size - share["blanks"]) / wide, distinct / np.maximum(np.sqrt(wide), 1), same / wide, most / wide,
        share["upper"] / some, share["digits"] / some, share["marks"] / wide, share["symbols"] / wide, share["bars"] / wide,
        share["blanks"] / some, np.log1p(lines), (lines - distinct_lines) / np.maximum(lines, 1)], axis=1).astype(np.float32)


def _featured(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for lo in range(0, batch.num_rows, 256):
            part = batch.slice(lo, 256)
            texts = [t or b"" for t in part.column(1).cast(pa.binary()).to_pylist()]
            rows, at = [], 0
            while at < len(texts):
                end, held = at, 0
                while end < len(texts) and (end == at or held + len(texts[end]) <= BLOCK_BYTES):
                    held += len(texts[end])
                    end += 1
                rows.append(features(texts[at:end]))
                at = end
            flat = pa.array(np.concatenate(rows).ravel())
            offsets = pa.array(np.arange(0, len(flat) + 1, len(FEATURES), dtype=np.int32))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.ListArray.from_arrays(offsets, flat)], names=["doc_id", "x"])


def feature_table(docs: DataFrame) -> DataFrame:
    kind = docs.schema["doc_id"].dataType.simpleString()
    rows = docs.select("doc_id", utf8(F.col("text")).alias("text"))
    return stored(map_arrow(rows, _featured, f"doc_id {kind}, x array<float>"), "quality-features")


@dataclass
class Model:
    edges: list[np.ndarray] = field(default_factory=list)
    start: float = 0.0
    tables: list[np.ndarray] = field(default_factory=list)
    #: (feature, feature, coarse edges of both, table)
    pairs: list[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.start)
        for f, (edges, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            total += table[np.searchsorted(edges, x[:, f], side="right")]
        for f, g, ef, eg, table in self.pairs:
            total += table[np.searchsorted(ef, x[:, f], side="right"), np.searchsorted(eg, x[:, g], side="right")]
        return 1 / (1 + np.exp(-total))


def _edges(x: np.ndarray, bins: int) -> np.ndarray:
    return np.unique(np.quantile(x, np.linspace(0, 1, bins + 1)[1:-1]))


def _step(grad: np.ndarray, hess: np.ndarray) -> np.ndarray:
    """A tree of up to LEAVES leaves over ordered bins: the value of every bin."""
    parts = [(0, len(grad))]
    gain_of = lambda lo, hi: grad[lo:hi].sum() ** 2 / (hess[lo:hi].sum() + RIDGE)
    while len(parts) < LEAVES:
        best = (1e-9, None, None)
        for lo, hi in parts:
            if hi - lo > 1:
                g, h = np.cumsum(grad[lo:hi]), np.cumsum(hess[lo:hi])
                gains = g[:-1] ** 2 / (h[:-1] + RIDGE) + (g[-1] - g[:-1]) ** 2 / (h[-1] - h[:-1] + RIDGE) - gain_of(lo, hi)
                at = int(gains.argmax())
                if gains[at] > best[0]:
                    best = (gains[at], (lo, hi), lo + at + 1)
        if best[1] is None:
            break
        parts.remove(best[1])
        parts += [(best[1][0], best[2]), (best[2], best[1][1])]
    out = np.zeros(len(grad))
    for lo, hi in parts:
        out[lo:hi] = -grad[lo:hi].sum() / (hess[lo:hi].sum() + RIDGE)
    return out


def _quadrants(grad: np.ndarray, hess: np.ndarray) -> tuple[float, np.ndarray]:
    """The best cut of a grid into four: its gain, and the value of every cell."""
    g, h = grad.cumsum(0).cumsum(1), hess.cumsum(0).cumsum(1)
    best, out = 0.0, np.zeros_like(grad)
    for a in range(grad.shape[0] - 1):
        for b in range(grad.shape[1] - 1):
            q = [(g[a, b], h[a, b]), (g[a, -1] - g[a, b], h[a, -1] - h[a, b]), (g[-1, b] - g[a, b], h[-1, b] - h[a, b]),
                 (g[-1, -1] - g[a, -1] - g[-1, b] + g[a, b], h[-1, -1] - h[a, -1] - h[-1, b] + h[a, b])]
            gain = sum(x * x / (y + RIDGE) for x, y in q)
            if gain > best:
                best = gain
                v = [-x / (y + RIDGE) for x, y in q]
                out[:a + 1, :b + 1], out[:a + 1, b + 1:], out[a + 1:, :b + 1], out[a + 1:, b + 1:] = v
    return best, out


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    model = Model()
    if not len(y):
        return model
    prior = (y.sum() + 1) / (len(y) + 2)
    model.start = float(np.log(prior / (1 - prior)))
    total = np.full(len(y), model.start)
    bins = []
    for f in range(x.shape[1]):
        model.edges.append(_edges(x[:, f], BINS))
        bins.append(np.searchsorted(model.edges[f], x[:, f], side="right"))
        model.tables.append(np.zeros(len(model.edges[f]) + 1))
    for _ in range(ROUNDS):
        for f, b in enumerate(bins):
            p = 1 / (1 + np.exp(-total))
            size = len(model.tables[f])
            step = RATE * _step(np.bincount(b, p - y, size), np.bincount(b, p * (1 - p), size))
            model.tables[f] += step
            total += step[b]
    coarse = [_edges(x[:, f], PAIR_BINS) for f in range(x.shape[1])]
    cell = [np.searchsorted(e, x[:, f], side="right") for f, e in enumerate(coarse)]

    def grids(f: int, g: int) -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        shape = (len(coarse[f]) + 1, len(coarse[g]) + 1)
        at = cell[f] * shape[1] + cell[g]
        return (np.bincount(at, p - y, shape[0] * shape[1]).reshape(shape), np.bincount(at, p * (1 - p), shape[0] * shape[1]).reshape(shape))

    ranked = sorted(combinations(range(x.shape[1]), 2), key=lambda fg: -_quadrants(*grids(*fg))[0])[:PAIRS]
    tables = {fg: np.zeros((len(coarse[fg[0]]) + 1, len(coarse[fg[1]]) + 1)) for fg in ranked}
    for _ in range(PAIR_ROUNDS):
        for f, g in ranked:
            step = RATE * _quadrants(*grids(f, g))[1]
            tables[f, g] += step
            total += step[cell[f], cell[g]]
    model.pairs = [(f, g, coarse[f], coarse[g], tables[f, g]) for f, g in ranked]
    return model


def train(table: DataFrame, labels: DataFrame, max_rows: int = TRAIN_ROWS) -> Model:
    """Fit on the labelled rows that are not held out; ``max_rows`` bounds the expected sample, chosen by hash."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    total = known.count()
    if total > max_rows:
        draw = F.shiftrightunsigned(F.xxhash64(F.lit("quality"), F.col("doc_id")), 1) / F.lit(float(1 << 63))
        known = known.filter(draw < max_rows / total)
    known = known.select(F.col("doc_id").alias("labelled"), "quality")
    rows = known.join(table, F.col("labelled") == F.col("doc_id")).select("doc_id", "quality", "x").collect()
    rows.sort(key=lambda r: (r.doc_id, r.quality, r.x))
    return fit(np.array([r.x for r in rows], dtype=np.float32).reshape(-1, len(FEATURES)), np.array([r.quality for r in rows], dtype=float))


def score_quality(docs: DataFrame, labels: DataFrame, least: float = 0.7, max_rows: int = TRAIN_ROWS) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    table = feature_table(docs)
    model = docs.sparkSession.sparkContext.broadcast(train(table, labels, max_rows))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = batch.column(1).flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(model.value.score(x))], names=["doc_id", "score"])

    scored = map_arrow(table, run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return scored.select("doc_id", (fold(F.col("doc_id")) == 2).alias("held_out"), "score", (F.col("score") >= least).cast("int").alias("predicted"))
