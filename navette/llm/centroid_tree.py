"""Vantage-point tree over integer centroids; nearest one by exact squared Euclidean distance."""

from __future__ import annotations

import numpy as np

#: Centroids of a leaf.
LEAF = 4
#: Distances to vantage points are square roots in double precision; this share and this much are added before pruning.
SLACK = 1e-9
#: Largest integer below which every intermediate of a matrix product in double precision is exact.
_EXACT = 1 << 53


def largest_component(dim: int) -> int:
    """Components up to this absolute value keep squared distances below 2^63."""
    return min(int(np.sqrt(2.0**63 / max(dim, 1)) / 2) - 1, (1 << 31) - 1)


def squared_distances(vectors: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Exact squared distances of integer rows, as integers."""
    most = int(max(np.abs(vectors).max(initial=0), np.abs(points).max(initial=0)))
    if 4 * vectors.shape[1] * most * most < _EXACT:
        v, p = vectors.astype(np.float64), points.astype(np.float64)
        return ((v * v).sum(1)[:, None] - 2 * (v @ p.T) + (p * p).sum(1)).astype(np.int64)
    return np.stack([((vectors - p) ** 2).sum(1) for p in points], axis=1)


class CentroidTree:
    """Inner nodes hold a vantage centroid and two children with the range of their distances to it.

    A child cannot be nearer than its range allows. Nodes are opened in the order of that bound, for all
    vectors of a block at once, until no open bound is within the best distance; a bound that equals it is still
    opened, so that of equal distances the smaller number wins.
    """

    def __init__(self, points: np.ndarray, leaf: int = LEAF):
        self.points = points
        self.nodes: list[tuple] = []
        self.leaf = leaf
        if len(points):
            self._build(np.arange(len(points)))

    def _build(self, members: np.ndarray) -> int:
        at = len(self.nodes)
        self.nodes.append(())
        if len(members) <= self.leaf:
            self.nodes[at] = (members, None)
            return at
        # the member farthest from the first one sees the others at the most different distances
        far = int(squared_distances(self.points[members[:1]], self.points[members])[0].argmax())
        vantage, others = members[far], np.delete(members, far)
        reach = np.sqrt(squared_distances(self.points[vantage][None], self.points[others])[0])
        order = np.argsort(reach, kind="stable")
        children = []
        for part in np.array_split(order, 2):
            children.append((self._build(np.sort(others[part])), reach[part].min(), reach[part].max()))
        self.nodes[at] = (np.array([vantage]), children)
        return at

    def nearest(self, vectors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the nearest point of each row, and its squared distance."""
        n = len(vectors)
        best = np.full(n, np.iinfo(np.int64).max)
        who = np.full(n, len(self.points))
        bound = np.full((n, len(self.nodes)), np.inf)
        bound[:, 0] = 0
        rows = np.arange(n)
        while len(rows):
            node = bound[rows].argmin(1)
            low = bound[rows, node]
            going = low <= np.sqrt(best[rows].astype(np.float64)) * (1 + SLACK) + SLACK
            rows, node, low = rows[going], node[going], low[going]
            bound[rows, node] = np.inf
            for k in np.unique(node).tolist():
                here = rows[node == k]
                members, children = self.nodes[k]
                found = squared_distances(vectors[here], self.points[members])
                # members are in ascending order, so the first minimum has the smallest number
                first = found.argmin(1)
                distance, number = found[np.arange(len(here)), first], members[first]
                better = (distance < best[here]) | ((distance == best[here]) & (number < who[here]))
                best[here[better]], who[here[better]] = distance[better], number[better]
                if children is None:
                    continue
                reach = np.sqrt(found[:, 0].astype(np.float64))
                for child, least, most in children:
                    bound[here, child] = np.maximum(low[node == k], np.maximum(reach - most, least - reach))
        return who, best
