"""MinHash signatures and candidate links of the regions of an LSH forest (numpy)."""

from __future__ import annotations

import numpy as np

from obsspark.llm.shingles import mix

#: trees, and hashes of each; a signature has TREES * DEPTH minima
TREES, DEPTH = 16, 8
_U = np.uint64
_FACTORS = np.random.Generator(np.random.PCG64(7)).integers(1, 2**63, size=TREES * DEPTH, dtype=np.uint64) * _U(2) + _U(1)


def signatures(offsets: np.ndarray, hashes: np.ndarray) -> np.ndarray:
    """One row of TREES * DEPTH 32-bit minima per set; zeros for an empty set."""
    out = np.zeros((len(offsets) - 1, TREES * DEPTH), dtype=np.uint32)
    some = np.flatnonzero(np.diff(offsets) > 0)
    if len(some):
        starts = offsets[some]
        for k, factor in enumerate(_FACTORS):
            out[some, k] = np.minimum.reduceat(((hashes * factor) >> _U(32)).astype(np.uint32), starts)
    return out


def fingerprints(offsets: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit sums over each set's mixed hashes."""
    out = []
    for salt in (0x5851F42D4C957F2D, 0x14057B7EF767814F):
        sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(hashes ^ _U(salt)), dtype=np.uint64)])
        out.append((sums[offsets[1:]] - sums[offsets[:-1]]).astype(np.int64))
    return out[0], out[1]


def similar_pairs(region: np.ndarray, size: np.ndarray, sig: np.ndarray, least: float, *, comp: np.ndarray | None = None,
                  tree: np.ndarray | None = None, keys: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pairs of rows of one region whose estimated similarity is ``least`` or more.

    ``region`` is sorted.  Pairs that cannot reach 0.75 by their set sizes are left out,
    and, if given, pairs of one component, and pairs that also share the region of
    an earlier tree (``keys`` has a row's regions of all trees, 0 for none).
    """
    starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
    counts = np.diff(np.concatenate([starts, [len(region)]]))
    left_over = np.repeat(starts + counts, counts) - np.arange(len(region))  # rows to the region's end
    need = int(np.ceil(least * sig.shape[1]))
    out_i, out_j, out_est = [], [], []
    for step in range(1, int(counts.max(initial=1))):
        i = np.flatnonzero(left_over > step)
        small, large = np.minimum(size[i], size[i + step]), np.maximum(size[i], size[i + step])
        ok = 100 * small >= 75 * large
        if comp is not None:
            ok &= comp[i] != comp[i + step]
        i = i[ok]
        for lo in range(0, len(i), 4096):
            part = i[lo:lo + 4096]
            if keys is not None:
                same = (keys[part] == keys[part + step]) & (keys[part] != 0) & (np.arange(keys.shape[1]) < tree[part][:, None])
                part = part[~same.any(axis=1)]
            equal = np.count_nonzero(sig[part] == sig[part + step], axis=1)
            hit = equal >= need
            out_i.append(part[hit])
            out_j.append(part[hit] + step)
            out_est.append(equal[hit] / sig.shape[1])
    if not out_i:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty, np.empty(0)
    return np.concatenate(out_i), np.concatenate(out_j), np.concatenate(out_est)


def spanning_forest(n: int, i: np.ndarray, j: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Edges of a maximum spanning forest (indices into i, j) and each node's component.

    Every round each component takes its heaviest edge to another one.
    """
    comp = np.arange(n)
    order = np.lexsort((j, i, -weight))
    rank = np.empty(len(i), dtype=np.int64)
    rank[order] = np.arange(len(i))
    chosen: list[np.ndarray] = []
    alive = np.arange(len(i))
    while len(alive):
        a, b = comp[i[alive]], comp[j[alive]]
        alive, a, b = alive[a != b], a[a != b], b[a != b]
        if not len(alive):
            break
        best = np.full(n, len(i))
        np.minimum.at(best, a, rank[alive])
        np.minimum.at(best, b, rank[alive])
        edges = order[np.unique(best[best < len(i)])]
        chosen.append(edges)
        # labels of the joined components: smallest one wins
        parent = np.arange(n)
        ea, eb = comp[i[edges]], comp[j[edges]]
        while True:
            low = np.minimum(parent[ea], parent[eb])
            before = parent.copy()
            np.minimum.at(parent, ea, low)
            np.minimum.at(parent, eb, low)
            parent = parent[parent]
            if np.array_equal(parent, before):
                break
        comp = parent[comp]
    return (np.concatenate(chosen) if chosen else np.empty(0, dtype=np.int64)), comp


def exact_links(region: np.ndarray, comp: np.ndarray, sets: list[np.ndarray], percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (indices) of one region, of different components, with 100 * intersection >= percent * union.

    Intersections are counted exactly over the shingles' lists of rows.
    """
    out_i, out_j = [], []
    starts = np.flatnonzero(np.concatenate([[True], region[1:] != region[:-1]]))
    for lo, hi in zip(starts, np.append(starts[1:], len(region)), strict=True):
        sizes = np.array([len(s) for s in sets[lo:hi]])
        _, term = np.unique(np.concatenate(sets[lo:hi]), return_inverse=True)
        row = np.repeat(np.arange(hi - lo), sizes)
        order = np.argsort(term, kind="stable")
        posting, ends = row[order], np.cumsum(np.bincount(term))
        begins = np.concatenate([[0], ends[:-1]])
        first = np.concatenate([[0], np.cumsum(sizes)])
        for i in range(hi - lo - 1):
            own = term[first[i]:first[i + 1]]
            lengths = ends[own] - begins[own]
            at = np.repeat(begins[own] - np.concatenate([[0], np.cumsum(lengths)[:-1]]), lengths) + np.arange(lengths.sum())
            common = np.bincount(posting[at], minlength=hi - lo)
            j = np.arange(i + 1, hi - lo)
            both = common[j]
            j = j[(100 * both >= percent * (sizes[i] + sizes[j] - both)) & (comp[lo + j] != comp[lo + i])]
            out_i.append(np.full(len(j), lo + i))
            out_j.append(lo + j)
    if not out_i:
        empty = np.empty(0, dtype=np.int64)
        return empty, empty
    return np.concatenate(out_i), np.concatenate(out_j)
