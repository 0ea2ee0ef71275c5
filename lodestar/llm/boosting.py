"""Gradient-boosted trees with logistic loss over dense features, and isotonic calibration; numpy only.

Made for fits on a bounded sample: the fit runs on one machine, the fitted model is a few kilobytes and is sent to tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Boosted:
    """Trees of one depth over binned features: ``feature`` and ``cut`` of each inner node, ``leaf`` values."""

    edges: list[np.ndarray]
    start: float
    depth: int
    feature: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    cut: np.ndarray = field(default_factory=lambda: np.zeros((0, 0), np.int64))
    leaf: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, j], side="right") for j, e in enumerate(self.edges)], axis=1)

    def margin(self, x: np.ndarray) -> np.ndarray:
        binned, rows = self.bins(x), np.arange(len(x))
        out = np.full(len(x), self.start)
        for feature, cut, leaf in zip(self.feature, self.cut, self.leaf, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (binned[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def fit_boosted(x: np.ndarray, y: np.ndarray, rounds: int = 120, depth: int = 3, rate: float = 0.12, ridge: float = 1.0, n_bins: int = 64) -> Boosted:
    """Second-order boosting on quantile histograms; a node without gain sends all rows to the left."""
    share = float(np.clip(y.mean(), 1e-4, 1 - 1e-4))
    model = Boosted([np.unique(np.quantile(x[:, j], np.linspace(0, 1, n_bins + 1)[1:-1])) for j in range(x.shape[1])], float(np.log(share / (1 - share))), depth)
    binned, width = model.bins(x), n_bins + 1
    margin = np.full(len(x), model.start)
    features, cuts, leaves = [], [], []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        grad, hess = p - y, p * (1 - p)
        node = np.zeros(len(x), np.int64)
        feature, cut = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, width, np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            best = np.full(n, 1e-6)
            for j in range(x.shape[1]):
                at = (node - first) * width + binned[:, j]
                g = np.bincount(at, grad, n * width).reshape(n, width)
                h = np.bincount(at, hess, n * width).reshape(n, width)
                gl, hl = g.cumsum(1), h.cumsum(1)
                gt, ht = gl[:, -1:], hl[:, -1:]
                gain = gl**2 / (hl + ridge) + (gt - gl) ** 2 / (ht - hl + ridge) - gt**2 / (ht + ridge)
                gain[(hl < 0.5) | (ht - hl < 0.5)] = 0
                top = gain.argmax(1)
                better = gain[np.arange(n), top] > best
                best[better] = gain[np.arange(n), top][better]
                feature[first : first + n][better], cut[first : first + n][better] = j, top[better]
            node = 2 * node + 1 + (binned[np.arange(len(x)), feature[node]] > cut[node])
        last = node - (2**depth - 1)
        leaf = -rate * np.bincount(last, grad, 2**depth) / (np.bincount(last, hess, 2**depth) + ridge)
        margin += leaf[last]
        features.append(feature), cuts.append(cut), leaves.append(leaf)
    model.feature, model.cut, model.leaf = np.array(features), np.array(cuts), np.array(leaves)
    return model


@dataclass
class Isotonic:
    """A non-decreasing map of scores, linear between the means of its blocks."""

    x: np.ndarray
    y: np.ndarray

    def __call__(self, score: np.ndarray) -> np.ndarray:
        return np.interp(score, self.x, self.y)


def fit_isotonic(score: np.ndarray, y: np.ndarray) -> Isotonic:
    """Pool adjacent violators; equal scores are one point."""
    points, inverse = np.unique(score, return_inverse=True)
    weight = np.bincount(inverse).astype(float)
    blocks: list[list[float]] = []  # sum of y, weight, sum of weighted score
    for s, w, total in zip(points, weight, np.bincount(inverse, y), strict=True):
        blocks.append([total, w, s * w])
        while len(blocks) > 1 and blocks[-2][0] * blocks[-1][1] >= blocks[-1][0] * blocks[-2][1]:
            last = blocks.pop()
            blocks[-1] = [a + b for a, b in zip(blocks[-1], last, strict=True)]
    return Isotonic(np.array([b[2] / b[1] for b in blocks]), np.array([b[0] / b[1] for b in blocks]))
