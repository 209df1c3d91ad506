"""Gradient-boosted trees (logistic loss, histogram splits) and isotonic calibration in numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Trees:
    """Complete binary trees of equal depth: ``features`` and ``cuts`` by tree and inner node, ``values`` by tree and leaf."""

    start: float
    features: np.ndarray
    cuts: np.ndarray
    values: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        rows = np.arange(len(x))
        inner = self.features.shape[1]
        for feature, cut, value in zip(self.features, self.cuts, self.values, strict=True):
            node = np.zeros(len(x), np.int64)
            while_depth = int(np.log2(inner + 1))
            for _ in range(while_depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += value[node - inner]
        return out


def fit_trees(x: np.ndarray, y: np.ndarray, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0,
              least: float = 1.0) -> Trees:
    """Newton boosting; splits are searched on ``bins`` quantile bins per feature.

    ``least`` is the smallest sum of second derivatives on either side of a split."""
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)], axis=1)
    share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    margin = np.full(n, start)
    inner, leaves = (1 << depth) - 1, 1 << depth
    features, cuts, values = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    for t in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            best_gain = np.full(count, 1e-9)
            for j in range(width):
                cells = (node - first) * bins + binned[:, j]
                gs = np.bincount(cells, g, count * bins).reshape(count, bins).cumsum(axis=1)
                hs = np.bincount(cells, h, count * bins).reshape(count, bins).cumsum(axis=1)
                total_g, total_h = gs[:, -1:], hs[:, -1:]
                gain = gs**2 / (hs + ridge) + (total_g - gs) ** 2 / (total_h - hs + ridge) - total_g**2 / (total_h + ridge)
                gain = np.where((hs >= least) & (total_h - hs >= least), gain, 0)[:, : len(edges[j])]
                if not gain.size:
                    continue
                at = gain.argmax(axis=1)
                better = np.flatnonzero(gain[np.arange(count), at] > best_gain)
                best_gain[better] = gain[better, at[better]]
                features[t, first + better] = j
                cuts[t, first + better] = edges[j][at[better]]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > cuts[t, node])
        leaf = node - inner
        values[t] = -rate * np.bincount(leaf, g, leaves) / (np.bincount(leaf, h, leaves) + ridge)
        margin += values[t, leaf]
    return Trees(start, features, cuts, values)


@dataclass
class Isotonic:
    """Nondecreasing piecewise linear map from margin to probability."""

    at: np.ndarray
    value: np.ndarray

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.value)


def fit_isotonic(margin: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; each block keeps its lowest and highest margin."""
    at, where = np.unique(margin, return_inverse=True)
    weight = np.bincount(where).astype(float)
    mean = np.bincount(where, y) / weight
    blocks: list[list[float]] = []  # mean, weight, lowest, highest
    for m, w, a in zip(mean, weight, at, strict=True):
        blocks.append([m, w, a, a])
        while len(blocks) > 1 and blocks[-2][0] >= blocks[-1][0]:
            m2, w2, _, high = blocks.pop()
            m1, w1, low, _ = blocks[-1]
            blocks[-1] = [(m1 * w1 + m2 * w2) / (w1 + w2), w1 + w2, low, high]
    return Isotonic(np.array([x for b in blocks for x in b[2:]]), np.array([b[0] for b in blocks for _ in range(2)]))
