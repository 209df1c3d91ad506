"""k-d trees over blocks of points, and nearest-centre sums by the filtering rule (numpy, inside tasks).

A tree keeps, for every node, its box and the count, mean and scatter of its
points. For given centres the walk carries the centres that can be nearest to
some point of a node's box; once a single one is left, the node's summary goes
to it and its points are not looked at. Only leaves that a boundary between
centres crosses compare their points.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

LEAF = 32
#: Points of a tree: a task builds several from a larger partition.
TREE_POINTS = 1 << 16
_SLACK = 1e-12


@dataclass
class Tree:
    """``points`` in leaf order with their ``keys``; node 0 is the root, ``child`` the first of two neighbours (-1: leaf)."""

    points: np.ndarray
    keys: np.ndarray
    first: np.ndarray
    last: np.ndarray
    child: np.ndarray
    low: np.ndarray
    high: np.ndarray
    mean: np.ndarray
    scatter: np.ndarray

    @staticmethod
    def build(points: np.ndarray, keys: np.ndarray, leaf: int = LEAF) -> Tree:
        points, keys = points.copy(), keys.copy()
        rows: list[list] = [[0, len(points), -1]]
        at = 0
        while at < len(rows):
            first, last, _ = rows[at]
            own = points[first:last]
            widths = own.max(axis=0) - own.min(axis=0)
            if last - first > leaf and widths.max() > 0:
                half = (last - first) // 2
                order = np.argpartition(own[:, widths.argmax()], half)
                points[first:last], keys[first:last] = own[order], keys[first:last][order]
                rows[at][2] = len(rows)
                rows += [[first, first + half, -1], [first + half, last, -1]]
            at += 1
        first, last, child = (np.array(c, np.int64) for c in zip(*rows, strict=True))
        own = [points[a:b] for a, b in zip(first, last, strict=True)]
        mean = np.array([x.mean(axis=0) for x in own])
        scatter = np.array([((x - m) ** 2).sum() for x, m in zip(own, mean, strict=True)])
        return Tree(points, keys, first, last, child, np.array([x.min(axis=0) for x in own]), np.array([x.max(axis=0) for x in own]), mean, scatter)

    def pack(self) -> dict[str, bytes]:
        nodes = np.column_stack([self.first, self.last, self.child, self.low, self.high, self.mean, self.scatter]).astype(np.float64)
        return {"points": self.points.tobytes(), "keys": self.keys.astype(np.int64).tobytes(), "nodes": nodes.tobytes()}

    @staticmethod
    def unpack(points: bytes, keys: bytes, nodes: bytes, dims: int) -> Tree:
        table = np.frombuffer(nodes).reshape(-1, 4 + 3 * dims)
        first, last, child = table[:, :3].astype(np.int64).T
        low, high, mean = (table[:, 3 + i * dims : 3 + (i + 1) * dims] for i in range(3))
        return Tree(np.frombuffer(points).reshape(-1, dims), np.frombuffer(keys, np.int64), first, last, child, low, high, mean, table[:, -1])


@dataclass
class CentreSums:
    """Per (restart, centre): points nearest to it, their coordinate sums and squared distances; and points compared one by one."""

    count: np.ndarray
    total: np.ndarray
    cost: np.ndarray
    compared: int = 0

    @staticmethod
    def zeros(restarts: int, k: int, dims: int) -> CentreSums:
        return CentreSums(np.zeros((restarts, k)), np.zeros((restarts, k, dims)), np.zeros((restarts, k)))

    def add(self, at: np.ndarray, count: np.ndarray, total: np.ndarray, cost: np.ndarray) -> None:
        """Add rows to the flat (restart * k + centre) positions ``at``."""
        size = self.count.size
        self.count += np.bincount(at, count, size).reshape(self.count.shape)
        self.cost += np.bincount(at, cost, size).reshape(self.cost.shape)
        for j in range(total.shape[1]):
            self.total[..., j] += np.bincount(at, total[:, j], size).reshape(self.count.shape)


def add_nearest(tree: Tree, centres: np.ndarray, sums: CentreSums) -> None:
    """Add the tree's points to their nearest of ``centres`` (restarts, k, dims); ties go to the lowest centre."""
    restarts, k, _ = centres.shape
    r, node = np.arange(restarts), np.zeros(restarts, np.int64)
    alive = np.ones((restarts, k), bool)
    index = np.arange(k)
    while len(r):
        own, low, high = centres[r], tree.low[node][:, None], tree.high[node][:, None]
        near = ((own - (low + high) / 2) ** 2).sum(axis=2)
        near[~alive] = np.inf
        star = near.argmin(axis=1)
        lead = own[np.arange(len(r)), star][:, None]
        corner = np.where(own >= lead, high, low)  # the point of the box that favours each centre most
        theirs, its = ((own - corner) ** 2).sum(axis=2), ((lead - corner) ** 2).sum(axis=2)
        alive &= (theirs <= its * (1 + _SLACK) + _SLACK) | (index == star[:, None])
        whole = alive.sum(axis=1) == 1
        if whole.any():
            n, c = node[whole], star[whole]
            many = (tree.last - tree.first)[n]
            gap = ((tree.mean[n] - lead[whole, 0]) ** 2).sum(axis=1)
            sums.add(r[whole] * k + c, many, tree.mean[n] * many[:, None], tree.scatter[n] + many * gap)
        leaf = ~whole & (tree.child[node] < 0)
        if leaf.any():
            n = node[leaf]
            many = (tree.last - tree.first)[n]
            entry = np.repeat(np.flatnonzero(leaf), many)
            x = tree.points[np.repeat(tree.first[n] - np.cumsum(many) + many, many) + np.arange(many.sum())]
            far = ((x[:, None] - centres[r[entry]]) ** 2).sum(axis=2)
            far[~alive[entry]] = np.inf
            c = far.argmin(axis=1)
            sums.add(r[entry] * k + c, np.ones(len(c)), x, far[np.arange(len(c)), c])
            sums.compared += len(c)
        go = np.flatnonzero(~whole & (tree.child[node] >= 0))
        r, alive = np.repeat(r[go], 2), np.repeat(alive[go], 2, axis=0)
        node = np.repeat(tree.child[node[go]], 2) + np.tile([0, 1], len(go))
