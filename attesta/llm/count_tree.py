"""Count vectors of sets and an R-tree over them.

The elements of a set are hashed into groups; how many fall into each group is a point. Two sets share at most the sum,
over the groups, of the smaller of the two counts, and a set shares no more than that with any set below a tree node when
the node's largest counts are taken instead. A point has about one group for every two elements, so it stays sharp for
sets of any size; points of different sharpness are compared after folding the finer one.
"""

from __future__ import annotations

import numpy as np

FANOUT = 8


def levels_of(sizes: np.ndarray) -> np.ndarray:
    """Number of groups, as a power of two: 8 at least, and one or two elements to a group."""
    return np.maximum(np.ceil(np.log2(np.maximum(sizes, 1) / 2)).astype(np.int64), 3)


def _counts(hashes: np.ndarray, rows: np.ndarray, levels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    at = np.concatenate([[0], np.cumsum(1 << levels)])
    group = at[rows] + (hashes >> (np.uint64(64) - levels[rows].astype(np.uint64))).astype(np.int64)
    return np.bincount(group, minlength=int(at[-1])), at


def points(hashes: np.ndarray, bounds: np.ndarray) -> list[bytes]:
    """The point of every set (sets lie one after the other in ``hashes``), one byte a count; where a count would not fit,
    all sets of the call get sharper points."""
    sizes = np.diff(bounds)
    rows, levels = np.repeat(np.arange(len(sizes)), sizes), levels_of(sizes)
    counts, at = _counts(hashes, rows, levels)
    while len(counts) and counts.max() > 255:
        levels += 1
        counts, at = _counts(hashes, rows, levels)
    raw = counts.astype(np.uint8).tobytes()
    return [raw[s:e] for s, e in zip(at[:-1].tolist(), at[1:].tolist())]


def fold(point: np.ndarray, groups: int) -> np.ndarray:
    """Counts of fewer groups: neighbours added up (groups are leading bits of the hash). Works on rows of points too."""
    while point.shape[-1] > groups:
        point = point[..., 0::2] + point[..., 1::2]
    return point


def needed(size_a, size_b, percent: int):
    """The overlap from which percent * union <= 100 * overlap."""
    return percent * (size_a + size_b) / (100 + percent)


class CountTree:
    """R-tree over points of one group of sets, packed by sorting on the leading coordinates."""

    def __init__(self, sizes: np.ndarray, raw: list[bytes], percent: int):
        self.percent = percent
        lowest = min(len(r) for r in raw)
        counts = np.array([fold(np.frombuffer(r, np.uint8).astype(np.int16), lowest) for r in raw])
        # sort-tile packing: like sizes together, then along the groups in which the points differ most
        axes = np.argsort(-counts.var(axis=0))[:2]
        tile = np.floor(np.log2(np.maximum(sizes, 1)) * 4).astype(np.int64)
        self.order = np.lexsort((counts[:, axes[-1]], counts[:, axes[0]], tile))
        self.sizes, self.counts = sizes[self.order], counts[self.order]
        self.levels = []  # from the leaves upwards: (largest counts, smallest size, largest size) of every node
        most, low, high = self.counts, self.sizes, self.sizes
        while len(most) > 1:
            cut = np.arange(0, len(most), FANOUT)
            most, low, high = np.maximum.reduceat(most, cut, axis=0), np.minimum.reduceat(low, cut), np.maximum.reduceat(high, cut)
            self.levels.append((most, low, high))

    def _may(self, i: int, most: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Nodes that may hold a partner of set i: by size, then by the sum of smaller counts."""
        size, p = self.sizes[i], self.percent
        fits = (100 * high >= p * size) & (p * low <= 100 * size)
        fits[fits] = np.minimum(most[fits], self.counts[i]).sum(axis=1) >= needed(size, np.maximum(low[fits], np.ceil(p * size / 100)), p) - 1e-9
        return fits

    def partners(self, i: int) -> np.ndarray:
        """Later members (in tree order) whose overlap bound reaches what set i needs."""
        nodes = np.array([0])
        for level in range(len(self.levels) - 1, -1, -1):
            most, low, high = self.levels[level]
            nodes = nodes[nodes < len(most)]
            nodes = nodes[self._may(i, most[nodes], low[nodes], high[nodes])]
            nodes = (nodes[:, None] * FANOUT + np.arange(FANOUT)).ravel()
        nodes = nodes[(nodes > i) & (nodes < len(self.sizes))]
        return nodes[np.minimum(self.counts[nodes], self.counts[i]).sum(axis=1) >= needed(self.sizes[nodes], self.sizes[i], self.percent) - 1e-9]


def bound_holds(raw_a: bytes, size_a: int, raw_b: bytes, size_b: int, percent: int) -> bool:
    """Whether two sets may reach the similarity: by their sizes and the sum of the smaller counts."""
    if 100 * min(size_a, size_b) < percent * max(size_a, size_b):
        return False
    a, b = np.frombuffer(raw_a, np.uint8), np.frombuffer(raw_b, np.uint8)
    groups = min(len(a), len(b))
    overlap = np.minimum(fold(a.astype(np.int32), groups), fold(b.astype(np.int32), groups)).sum()
    return bool(overlap >= needed(size_a, size_b, percent) - 1e-9)
