"""Word shingles of texts as arrays of 64-bit hashes (numpy, whole batches at once).

Words are runs of bytes that are not ASCII white space (0x20, 0x09-0x0D) after
lower-casing A-Z.  A shingle hash is a polynomial over 64-bit word hashes, which
are polynomials over random byte codes; both end in a bit mixer.  Equal word
sequences always have equal hashes; different ones collide with probability
about 2**-64 per pair.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

_U = np.uint64
_WORD_BASE = _U(0x9E3779B97F4A7C15)
_SHINGLE_BASE = _U(0xD6E8FEB86659FD93)
_CODES = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, size=256, dtype=np.uint64)
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
#: bytes hashed at once; bounds the temporary arrays (about 60 bytes per byte)
BLOCK_BYTES = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    x = x ^ (x >> _U(33))
    x = x * _U(0xFF51AFD7ED558CCD)
    x = x ^ (x >> _U(33))
    x = x * _U(0xC4CEB9FE1A85EC53)
    return x ^ (x >> _U(33))


def _inverse(base: int) -> int:
    return pow(int(base), -1, 1 << 64)


class _Powers:
    """Powers of a base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: np.uint64) -> None:
        self.base, self.inv = base, _U(_inverse(base))
        self.up = self.down = np.ones(1, dtype=np.uint64)

    def upto(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            n = max(n, 2 * len(self.up))
            self.up = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, self.base)]), dtype=np.uint64)
            self.down = np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(n - 1, self.inv)]), dtype=np.uint64)
        return self.up, self.down


_WORD_POWERS = _Powers(_WORD_BASE)


def word_hashes(data: bytes) -> np.ndarray:
    """64-bit hashes of the words of a UTF-8 byte string, in order."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    up, down = _WORD_POWERS.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_CODES[_LOWER[raw]] * up[: len(raw)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def _raw_runs(data: bytes) -> tuple[np.ndarray, np.ndarray, bool, bool]:
    """(polynomial, length) of the words of a byte string, and whether it begins and ends inside a word."""
    raw = np.frombuffer(data, dtype=np.uint8)
    space = _SPACE[raw]
    edge = np.flatnonzero(np.diff(np.concatenate([[True], space, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    up, down = _WORD_POWERS.upto(len(raw) + 1)
    total = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum(_CODES[_LOWER[raw]] * up[: len(raw)], out=total[1:])
    return (total[ends] - total[starts]) * down[starts], (ends - starts).astype(np.uint64), not space[0], not space[-1]


def word_runs(data: bytes) -> np.ndarray:
    """``word_hashes`` of a text of any length: pieces of BLOCK_BYTES at a time, words that cross them put together."""
    if len(data) <= BLOCK_BYTES:
        return word_hashes(data)
    values, sizes, open_word = [], [], False
    for lo in range(0, len(data), BLOCK_BYTES):
        value, size, begins, ends = _raw_runs(data[lo:lo + BLOCK_BYTES])
        if open_word and begins:
            last, before = values[-1], sizes[-1]
            last[-1:] += value[:1] * _U(pow(int(_WORD_BASE), int(before[-1]), 1 << 64))
            before[-1] += size[0]
            value, size = value[1:], size[1:]
        if len(value):
            values.append(value)
            sizes.append(size)
        open_word = ends
    if not values:
        return np.empty(0, dtype=np.uint64)
    return mix(np.concatenate(values) + np.concatenate(sizes))


def _blocks(texts: list[bytes]) -> Iterator[tuple[int, int]]:
    lo, size = 0, 0
    for i, t in enumerate(texts):
        if i > lo and size + len(t) > BLOCK_BYTES:
            yield lo, i
            lo, size = i, 0
        size += len(t) + 1
    if lo < len(texts):
        yield lo, len(texts)


def shingle_sets(texts: list[bytes], width: int = 5) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Distinct shingles of every text, a block of texts at a time.

    Yields (index of the first text, offsets, hashes): text ``first + i`` has the
    sorted distinct hashes ``hashes[offsets[i]:offsets[i + 1]]``.  A text of 1 to
    ``width - 1`` words has its whole sequence as one shingle; one without words
    has none.
    """
    for lo, hi in _blocks(texts):
        part = texts[lo:hi]
        words = word_hashes(b"\n".join(part))
        # words per text: word starts that fall into the text's byte range
        raw = np.frombuffer(b"\n".join(part), dtype=np.uint8)
        space = np.concatenate([[True], _SPACE[raw]])
        starts = np.flatnonzero(space[:-1] & ~space[1:])
        cuts = np.concatenate([[0], np.cumsum([len(t) + 1 for t in part])])
        at = np.searchsorted(starts, cuts)
        at[-1] = len(words)
        counts = np.diff(at)
        per = np.where(counts >= width, counts - width + 1, np.minimum(counts, 1))
        first = np.concatenate([[0], np.cumsum(per)])
        doc = np.repeat(np.arange(len(part)), per)
        begin = at[:-1][doc] + (np.arange(first[-1]) - first[:-1][doc])
        length = np.minimum(counts[doc], width)
        padded = np.concatenate([words, np.zeros(width, dtype=np.uint64)])
        value = length.astype(np.uint64)
        for k in range(width):
            value = value * _SHINGLE_BASE + np.where(k < length, padded[begin + k], _U(0))
        value = mix(value)
        order = np.lexsort((value, doc))
        value, doc = value[order], doc[order]
        keep = np.ones(len(value), dtype=bool)
        keep[1:] = (value[1:] != value[:-1]) | (doc[1:] != doc[:-1])
        value, doc = value[keep], doc[keep]
        yield lo, np.searchsorted(doc, np.arange(len(part) + 1)), value
