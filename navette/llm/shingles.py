"""Word shingles of documents as sorted sets of 64-bit hashes."""

from __future__ import annotations

import numpy as np

from navette.llm.common import ByteHash, lowered, mix, words

WIDTH = 5

_WEIGHTS = np.random.default_rng(77).integers(0, 2**63, WIDTH + 1, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def shingle_sets(buf: np.ndarray, offsets: np.ndarray, width: int = WIDTH) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingles of the rows, sorted within each row, and the offsets of the rows.

    A row with fewer words than the width has its whole sequence as the only shingle;
    a row without words has none.
    """
    buf = lowered(buf)
    row, start, stop = words(buf, offsets)
    n_rows = len(offsets) - 1
    hashes = ByteHash(buf).spans(start, stop) if len(start) else np.zeros(0, np.uint64)
    count = np.bincount(row, minlength=n_rows)
    first = np.cumsum(count) - count
    full = max(len(hashes) - width + 1, 0)
    rolled = np.zeros(full, np.uint64)
    for i in range(width):
        rolled += hashes[i : i + full] * _WEIGHTS[i]
    keep = row[:full] == row[width - 1 :] if full else np.zeros(0, bool)
    rolled, owner = mix(rolled[keep]), row[:full][keep]
    short = np.flatnonzero((count > 0) & (count < width))
    if len(short):
        whole = np.zeros(len(short), np.uint64)
        for i in range(width - 1):
            there = count[short] > i
            whole[there] += hashes[first[short[there]] + i] * _WEIGHTS[i]
        whole = mix(whole + count[short].astype(np.uint64) * _WEIGHTS[width])
        rolled, owner = np.concatenate([rolled, whole]), np.concatenate([owner, short])
        order = np.argsort(owner, kind="stable")
        rolled, owner = rolled[order], owner[order]
    bounds = np.searchsorted(owner, np.arange(n_rows + 1))
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
        rolled[a:b].sort()
    new = np.ones(len(rolled), bool)
    new[1:] = (rolled[1:] != rolled[:-1]) | (owner[1:] != owner[:-1])
    rolled, owner = rolled[new], owner[new]
    return rolled, np.searchsorted(owner, np.arange(n_rows + 1))


def row_sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Sum of each row's values (modulo 2^64)."""
    total = np.zeros(len(values) + 1, np.uint64)
    np.cumsum(values, out=total[1:])
    return total[bounds[1:]] - total[bounds[:-1]]
