"""Histogram gradient-boosted trees (logistic loss) in NumPy, flattened into
arrays: complete binary trees, traversed for all rows and trees at once."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class BoostedTrees:
    """``feature``/``threshold``: (trees, inner nodes); ``value``: (trees, leaves)."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def score(self, x: np.ndarray, block: int = 2048) -> np.ndarray:
        """Probability of label 1 of each row of ``x``."""
        out = np.empty(len(x))
        trees = np.arange(len(self.feature))
        depth = int(np.log2(self.value.shape[1])) if len(trees) else 0
        for a in range(0, len(x), block):
            rows = x[a:a + block]
            at = np.zeros((len(rows), len(trees)), np.int64)
            line = np.arange(len(rows))[:, None]
            for _ in range(depth):
                at = 2 * at + 1 + (rows[line, self.feature[trees, at]] > self.threshold[trees, at])
            margin = self.base + self.value[trees, at - (self.value.shape[1] - 1)].sum(axis=1) if len(trees) \
                else np.full(len(rows), self.base)
            out[a:a + block] = 1.0 / (1.0 + np.exp(-margin))
        return out


def fit_boosted(x: np.ndarray, y: np.ndarray, trees: int = 120, depth: int = 4, rate: float = 0.1,
                bins: int = 64, penalty: float = 1.0, least: float = 5.0) -> BoostedTrees:
    """Fit on a bounded sample. Without rows or with one label only, a constant."""
    n, d = x.shape
    rate_of_ones = (y.sum() + 0.5) / (n + 1.0)
    base = float(np.log(rate_of_ones / (1.0 - rate_of_ones)))
    inner, leaves = (1 << depth) - 1, 1 << depth
    if n == 0 or y.min() == y.max():
        return BoostedTrees(base, np.zeros((0, inner), np.int64), np.zeros((0, inner)), np.zeros((0, leaves)))
    cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, bins + 1)[1:-1])) for j in range(d)]
    width = bins
    binned = np.column_stack([np.searchsorted(c, x[:, j], "left") for j, c in enumerate(cuts)])
    slot = binned + np.arange(d) * width
    margin = np.full(n, base)
    features, thresholds, values = [], [], []
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1.0 - p), 1e-9)
        node = np.zeros(n, np.int64)                       # heap index
        feature, threshold = np.zeros(inner, np.int64), np.full(inner, np.inf)
        for level in range(depth):
            first, count = (1 << level) - 1, 1 << level
            cell = ((node - first)[:, None] * (d * width) + slot).ravel()
            shape = (count, d, width)
            g = np.bincount(cell, np.repeat(grad, d), count * d * width).reshape(shape)
            h = np.bincount(cell, np.repeat(hess, d), count * d * width).reshape(shape)
            left_g, left_h = g.cumsum(axis=2), h.cumsum(axis=2)
            all_g, all_h = left_g[:, :, -1:], left_h[:, :, -1:]
            gain = (left_g ** 2 / (left_h + penalty) + (all_g - left_g) ** 2 / (all_h - left_h + penalty)
                    - all_g ** 2 / (all_h + penalty))
            gain[(left_h < least / 4) | (all_h - left_h < least / 4)] = 0.0
            flat = gain.reshape(count, -1)
            best = flat.argmax(axis=1)
            for i in range(count):
                j, b = divmod(int(best[i]), width)
                if flat[i, best[i]] > 1e-9 and b < len(cuts[j]):
                    feature[first + i], threshold[first + i] = j, cuts[j][b]
            node = 2 * node + 1 + (x[np.arange(n), feature[node]] > threshold[node])
        leaf = node - inner
        value = -rate * np.bincount(leaf, grad, leaves) / (np.bincount(leaf, hess, leaves) + penalty)
        margin += value[leaf]
        features.append(feature)
        thresholds.append(threshold)
        values.append(value)
    return BoostedTrees(base, np.array(features), np.array(thresholds), np.array(values))
