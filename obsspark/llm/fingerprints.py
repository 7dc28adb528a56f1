"""Document fingerprints by consistent weighted sampling.

A document's terms are its words and its pairs of neighbouring words, weighted by how often
they occur; words are runs without ASCII white space, A-Z lower-cased.  Each of SAMPLES
samples draws, from a hash of (term, sample) alone, r and c, both Gamma(2, 1), and a uniform
b, quantises the weight w to t = floor(ln w / r + b), and scores the term
c / exp(r (t - b + 1)); the term of the least score, with its t, is the sample.  Two documents
have equal samples with a probability equal to the generalised Jaccard similarity of their
weights, sum of minima over sum of maxima.  A Gamma(2, 1) value is drawn as the sum of two
exponentials e1 + e2, and then b = e1 / r is uniform and independent of r, so that a term of
weight 1 (t = 0) scores c / exp(e2).

A fingerprint holds 16 bits of each sample: different samples agree by chance with a
probability of 1 / 65535, which likeness() takes off.  Its standard error is at most
0.5 / sqrt(SAMPLES).

Defined cases: null text is empty; a text without words has the fingerprint of zeros, alike
only to others of this kind; documents are ordered by doc_id, null after all others, equal
ids by a hash of the text; a lone document is its own next; an empty table gives no rows;
other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import sha256

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from obsspark.llm.common import map_arrow, stored
from obsspark.llm.shingles import mix, word_runs

#: samples of a fingerprint
SAMPLES = 64
#: bytes of texts, and terms, handled at once
TEXT_BYTES, TERMS = 1 << 18, 1 << 15

_U = np.uint64
_FACTORS = np.random.Generator(np.random.PCG64(11)).integers(1, 2**62, size=1024, dtype=np.uint64) * _U(2) + _U(1)
_STIR = _U(0xFF51AFD7ED558CCD)
_PAIR = _U(0xD6E8FEB86659FD93)
_UNIT = np.float32(1 / (1 << 16))


def weighted_terms(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(offsets, terms, weights): text i has the distinct terms ``offsets[i]:offsets[i + 1]``."""
    counts, terms, weights = [0], [np.empty(0, _U)], [np.empty(0, np.int64)]
    for text in texts:
        words = word_runs(text)
        every = np.sort(np.concatenate([words, mix(words[:-1] * _PAIR + words[1:])]))
        new = np.ones(len(every), dtype=bool)
        np.not_equal(every[1:], every[:-1], out=new[1:])
        at = np.flatnonzero(new)
        counts.append(len(at))
        terms.append(every[at])
        weights.append(np.diff(np.append(at, len(every))))
    return np.cumsum(counts), np.concatenate(terms), np.concatenate(weights)


_NONE = np.iinfo(np.uint64).max


def least_keys(offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """The least (score, tag) of every sample (row) and every run of terms (column)."""
    best = np.full((samples, len(offsets) - 1), _NONE, dtype=_U)
    for lo in range(0, len(terms), TERMS):
        hi = min(lo + TERMS, len(terms))
        term = terms[lo:hi]
        heavy = np.flatnonzero(weights[lo:hi] > 1)
        log_w = np.log(weights[lo:hi][heavy].astype(np.float32))
        docs = np.arange(np.searchsorted(offsets, lo, side="right") - 1, np.searchsorted(offsets, hi, side="left"))
        docs = docs[offsets[docs + 1] > offsets[docs]]
        starts = np.maximum(offsets[docs], lo) - lo
        z, y, key = np.empty_like(term), np.empty_like(term), np.zeros_like(term)
        # four numbers of 16 bits of every hash; a sample's key is the score's bits above those of the tag
        u, score_bits, tag = z.view(np.uint16).reshape(-1, 4), key.view(np.uint32).reshape(-1, 2)[:, 1], key.view(np.uint16).reshape(-1, 4)[:, 0]
        for k in range(samples):
            np.multiply(term, _FACTORS[k], out=z)
            np.right_shift(z, _U(32), out=y)
            np.bitwise_xor(z, y, out=z)
            np.multiply(z, _STIR, out=z)
            unit = u.astype(np.float32)
            unit += np.float32(0.5)
            unit *= _UNIT
            c = np.log(unit[:, 0] * unit[:, 1])
            # exp(score) = c exp(-e2), c = -ln(u0 u1), e2 = -ln u2, e1 = -ln u3
            score = c * unit[:, 2]
            np.maximum(u[:, 3], np.uint16(1), out=tag)
            if len(heavy):
                e1 = -np.log(unit[heavy, 3])
                r = e1 - np.log(unit[heavy, 2])
                t = np.floor((log_w + e1) / r)
                score[heavy] *= np.exp(-r * t)
                tag[heavy] = np.maximum(tag[heavy] + (t * np.float32(40503)).astype(np.int64).astype(np.uint16), np.uint16(1))
            np.negative(score, out=score)
            score_bits[:] = score.view(np.uint32)
            best[k, docs] = np.minimum(best[k, docs], np.minimum.reduceat(key, starts))
    return best


def _tags(best: np.ndarray) -> np.ndarray:
    return np.where(best == _U(_NONE), _U(0), best).T.astype(np.uint16)


def sampled(offsets: np.ndarray, terms: np.ndarray, weights: np.ndarray, samples: int = SAMPLES) -> np.ndarray:
    """One row of ``samples`` 16-bit samples per document, zeros for one without terms."""
    return _tags(least_keys(offsets, terms, weights, samples))


def paired(texts: list[str], others: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Fingerprints of texts and of other texts, each pair's common (term, weight) sampled once."""
    out, at = [], 0
    while at < len(texts):
        lo, size = at, 0
        while at < len(texts) and size < TEXT_BYTES:
            size += len(texts[at])
            at += 1
        offsets, terms, weights = weighted_terms([x.encode() for i in range(lo, at) for x in (texts[i], others[i])])
        bounds, order = [0], []
        for i in range(0, len(offsets) - 1, 2):
            a, b, end = offsets[i:i + 3]
            place = np.minimum(np.searchsorted(terms[b:end], terms[a:b]), max(end - b - 1, 0)) + b
            common = np.zeros(b - a, dtype=bool) if a == b or b == end else (terms[place] == terms[a:b]) & (weights[place] == weights[a:b])
            rest = np.ones(end - b, dtype=bool)
            rest[place[common] - b] = False
            runs = a + np.flatnonzero(~common), a + np.flatnonzero(common), b + np.flatnonzero(rest)
            order += runs
            bounds += [len(r) for r in runs]
        take = np.concatenate(order)
        best = least_keys(np.cumsum(bounds), terms[take], weights[take])
        out.append((_tags(np.minimum(best[:, 0::3], best[:, 1::3])), _tags(np.minimum(best[:, 1::3], best[:, 2::3]))))
    a, b = zip(*out, strict=True)
    return np.concatenate(a), np.concatenate(b)


def fingerprints(texts: list[str]) -> np.ndarray:
    """One row of 16-bit samples per text; texts are taken in blocks, a long one by itself."""
    out, part, size = [], [], 0
    for text in texts:
        part.append(text.encode())
        size += len(part[-1])
        if size >= TEXT_BYTES:
            out.append(sampled(*weighted_terms(part)))
            part, size = [], 0
    if part:
        out.append(sampled(*weighted_terms(part)))
    return np.concatenate(out) if out else np.empty((0, SAMPLES), np.uint16)


def likeness(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Estimated similarity of rows of fingerprints: the share of equal samples, less what chance gives."""
    equal = (a == b).mean(axis=1)
    return np.where((a[:, 0] == 0) == (b[:, 0] == 0), np.clip((equal * 65535 - 1) / 65534, 0, 1), 0.0)


def edited(text: str, following: str) -> str:
    """The text with the first code points of the following one in place of its last third."""
    n = len(text) // 3
    return text[:len(text) - n] + following[:n]


_ROW = "part int, place int, doc_id long, n_chars long, edited_sha256 string, fingerprint binary, edited_fingerprint binary, near_edited double, near_next double, text string"
_FIELDS = [f.split()[0] for f in _ROW.split(", ")]
_TYPES = [pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.string(), pa.binary(), pa.binary(), pa.float64(), pa.float64(), pa.string()]
#: places of a row: done; the first or the last of its part, whose other half lies in another part; both
DONE, FIRST, LAST = 0, 1, 2


def _finished(part: int, ids: list, texts: list[str], last_mark: np.ndarray) -> tuple[list[tuple], np.ndarray]:
    """Rows of all texts but the last one, each with the next, and the first text's samples."""
    changed = [edited(t, n) for t, n in zip(texts, texts[1:], strict=False)]
    marks, other = paired(texts[:-1], changed)
    following = np.vstack([marks[1:], last_mark])
    rows = [(part, DONE, i, len(t), sha256(c.encode()).hexdigest(), m.tobytes(), o.tobytes(), e, n, None) for i, t, c, m, o, e, n in zip(
        ids, texts, changed, marks, other, likeness(marks, other).tolist(), likeness(marks, following).tolist(), strict=False)]
    return rows, marks[0]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), _TYPES, strict=True)], _FIELDS)


def _along(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of one part in order: each finished with the next row's text; the part's ends are handed on with their texts."""
    part = TaskContext.get().partitionId()
    held = None
    for batch in batches:
        all_ids = batch.column("doc_id").to_pylist()
        column = batch.column("text")
        lo = 0
        while lo < len(all_ids):
            texts, size, hi = [], 0, lo
            while hi < len(all_ids) and size < 4 * TEXT_BYTES:
                texts.append(column[hi].as_py() or "")
                size += len(texts[-1])
                hi += 1
            ids, lo = all_ids[lo:hi], hi
            if held is not None:
                ids, texts = [held[0], *ids], [held[1], *texts]
            mark = fingerprints(texts[-1:])
            first = mark[0]
            if len(ids) > 1:
                rows, first = _finished(part, ids, texts, mark)
                yield _batch(rows)
            if held is None:
                yield _batch([(part, FIRST, None, None, None, first.tobytes(), None, None, None, texts[0])])
            held = ids[-1], texts[-1]
    if held is not None:
        yield _batch([(part, LAST, held[0], None, None, None, None, None, None, held[1])])


def _across(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Last rows of parts, each with the first row of the part that follows."""
    for batch in batches:
        for i, doc_id in enumerate(batch.column("doc_id").to_pylist()):
            text, following, mark = (batch.column(c)[i].as_py() for c in ("text", "next_text", "next_fingerprint"))
            yield _batch(_finished(0, [doc_id], [text, following], np.frombuffer(mark, np.uint16)[None])[0])


def weighted_fingerprints(docs: DataFrame) -> DataFrame:
    """One row per document, in descending order of doc_id its fingerprint, that of its text edited
    with the next one's, and both likenesses.

    Texts are shuffled once, into ranges of doc_id; ties are broken down to the row, so that
    a range can end inside rows that are all alike.  Each task finishes all rows but its last
    one, which needs the first row of the next range; those ends, two rows a task, are
    joined by the numbers of the tasks.
    """
    rows = docs.select("doc_id", F.col("text"), F.xxhash64("text").alias("tie"), F.monotonically_increasing_id().alias("rid"))
    order = [F.col("doc_id").desc_nulls_last(), "tie", "rid"]
    parts = stored(map_arrow(rows.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text"), _along, _ROW), "fingerprints")
    # one number per task: the task that follows, the first one after the last
    tasks = parts.filter(F.col("place") == FIRST).select("part")
    once = Window.orderBy("part")
    following = F.coalesce(F.lead("part").over(once), F.first("part").over(once))
    after = tasks.select(F.col("part").alias("_at"), following.alias("_next"))
    first = parts.filter(F.col("place") == FIRST).select(F.col("part").alias("_first"), F.col("text").alias("next_text"),
                                                         F.col("fingerprint").alias("next_fingerprint"))
    last = (parts.filter(F.col("place") == LAST).select("part", "doc_id", "text")
            .join(after, F.col("part") == F.col("_at")).join(first, F.col("_next") == F.col("_first"))
            .select("doc_id", "text", "next_text", "next_fingerprint"))
    done = parts.filter(F.col("place") == DONE).unionByName(map_arrow(last, _across, _ROW))
    return done.select("doc_id", "n_chars", "edited_sha256", F.lower(F.hex("fingerprint")).alias("fingerprint"),
                       F.lower(F.hex("edited_fingerprint")).alias("edited_fingerprint"), "near_edited", "near_next")
