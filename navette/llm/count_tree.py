"""R-tree over count vectors, searched by an upper bound of the overlap of two sets."""

from __future__ import annotations

import numpy as np

GROUPS = 256
#: Groups of the longer vector of a large set. With few groups, large sets of like size all look alike.
FINE_GROUPS = 4096
#: Elements from which a set has the longer vector too.
LARGE = 2048
#: A count that does not fit is stored as this value and bounds nothing.
FULL = 255
FANOUT = 16


def count_vectors(hashes: np.ndarray, bounds: np.ndarray, groups: int = GROUPS) -> np.ndarray:
    """Per row, how many of its set's hashes fall into each group."""
    rows = len(bounds) - 1
    owner = np.repeat(np.arange(rows), np.diff(bounds))
    cell = owner * groups + (hashes >> np.uint64(48)).astype(np.int64) % groups
    counts = np.bincount(cell, minlength=rows * groups)
    return np.minimum(counts, FULL).astype(np.uint8).reshape(rows, groups)


def least_overlap(n: np.ndarray, m: np.ndarray, percent: int) -> np.ndarray:
    """Smallest intersection of sets of n and m elements whose Jaccard similarity reaches the percentage."""
    return -(-(percent * (n.astype(np.int64) + m)) // (100 + percent))


def overlap_bound(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Summed coordinate minima; no intersection is larger. Rows against rows."""
    low = np.minimum(a, b)
    bound = low.sum(axis=-1, dtype=np.int64)
    bound[(low == FULL).any(axis=-1)] = np.iinfo(np.int64).max
    return bound


class CountTree:
    """Packed tree: points sorted by set size, then by vector; a node keeps the largest counts and sizes below it.

    ``finer``: per point its longer vector, or None; a second bound where both sides have one.
    """

    def __init__(self, vectors: np.ndarray, sizes: np.ndarray, finer: list | None = None):
        self.sizes = sizes
        large = [i for i, v in enumerate(finer or []) if v is not None]
        self.place = np.full(len(sizes), -1)
        self.place[large] = np.arange(len(large))
        self.finer = np.stack([finer[i] for i in large]) if large else None
        order = np.lexsort((*vectors[:, :4].T, sizes))
        self.order = order
        self.levels = [(vectors[order], sizes[order], sizes[order])]
        while len(self.levels[-1][1]) > FANOUT:
            high, low, top = self.levels[-1]
            cuts = np.arange(0, len(low), FANOUT)
            self.levels.append(
                (np.maximum.reduceat(high, cuts), np.minimum.reduceat(low, cuts), np.maximum.reduceat(top, cuts))
            )

    def search(
        self, vector: np.ndarray, size: int, percent: int, finer: np.ndarray | None = None
    ) -> tuple[np.ndarray, np.ndarray]:
        """Indices of the points whose bound allows the similarity, and by how much the bound is above the need."""
        found = np.arange(len(self.levels[-1][1]))
        for depth in range(len(self.levels) - 1, -1, -1):
            high, low, top = self.levels[depth]
            fits = (100 * top[found] >= percent * size) & (percent * low[found] <= 100 * size)
            found = found[fits]
            spare = overlap_bound(high[found], vector[None, :]) - least_overlap(low[found], size, percent)
            found, spare = found[spare >= 0], spare[spare >= 0]
            if depth:
                below = len(self.levels[depth - 1][1])
                found = (found[:, None] * FANOUT + np.arange(FANOUT)).ravel()
                found = found[found < below]
        found = self.order[found]
        if finer is None or self.finer is None:
            return found, spare
        place = self.place[found]
        long = place >= 0
        both = found[long]
        need = least_overlap(self.sizes[both], size, percent)
        spare[long] = np.minimum(spare[long], overlap_bound(self.finer[place[long]], finer[None, :]) - need)
        return found[spare >= 0], spare[spare >= 0]
