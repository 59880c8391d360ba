"""Gradient-boosted trees for a few hundred thousand rows of small integer features, with a calibrated threshold."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_BINS = 32


@dataclass
class Boosted:
    """Trees of fixed depth: each level of a tree has one (feature, cut) for each of its nodes; leaves hold log odds."""

    base: float = 0.0
    trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = field(default_factory=list)
    depth: int = 3

    def raw(self, x: np.ndarray) -> np.ndarray:
        out, rows = np.full(len(x), self.base), np.arange(len(x))
        for feature, cut, leaf in self.trees:
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > cut[node])
            out += leaf[node - (2**self.depth - 1)]
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.raw(x), -30, 30)))


def fit(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2, l2: float = 1.0) -> Boosted:
    """Newton boosting of the logistic loss on histograms; features are integers from 0 to 31."""
    x = np.clip(x, 0, _BINS - 1).astype(np.int64)
    p = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    model = Boosted(float(np.log(p / (1 - p))), depth=depth)
    raw, width = np.full(len(x), model.base), x.shape[1]
    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        g, h = y - p, np.maximum(p * (1 - p), 1e-6)
        feature, cut, node = np.zeros(2**depth - 1, np.int64), np.full(2**depth - 1, _BINS), np.zeros(len(x), np.int64)
        for level in range(depth):
            first, n = 2**level - 1, 2**level
            at = ((node - first)[:, None] * width + np.arange(width)) * _BINS + x
            size = n * width * _BINS
            sums = [np.bincount(at.ravel(), np.repeat(v, width), size).reshape(n, width, _BINS).cumsum(axis=2) for v in (g, h)]
            left, right = sums, [s[:, :, -1:] - s for s in sums]
            gain = sum(a[0] ** 2 / (a[1] + l2) for a in (left, right))
            best = gain.reshape(n, -1).argmax(axis=1)
            feature[first : first + n], cut[first : first + n] = best // _BINS, best % _BINS
            node = 2 * node + 1 + (x[np.arange(len(x)), feature[node]] > cut[node])
        leaf_of = node - (2**depth - 1)
        leaf = rate * np.bincount(leaf_of, g, 2**depth) / (np.bincount(leaf_of, h, 2**depth) + l2)
        model.trees.append((feature, cut, leaf))
        raw += leaf[leaf_of]
    return model


def threshold(scores: np.ndarray, y: np.ndarray, precision: float, least: float = 0.5) -> float:
    """The least score, from `least` on, above which the wanted precision holds on held-out rows; above 1 if none does."""
    order = np.argsort(-scores, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1)
    sure = np.flatnonzero((good >= precision) & (scores[order] >= least))
    return float(scores[order][sure[-1]]) if len(sure) else 1.1
