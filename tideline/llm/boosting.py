"""Gradient-boosted trees for a yes-or-no label, on binned features."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Forest:
    """Complete binary trees: per tree the inner nodes' feature and threshold, and the leaves' values."""

    base: float
    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row."""
        out = np.full(len(x), self.base)
        if not len(x):
            return out
        rows, depth = np.arange(len(x)), int(np.log2(self.value.shape[1]))
        for feature, threshold, value in zip(self.feature, self.threshold, self.value, strict=True):
            node = np.zeros(len(x), np.int64)
            for _ in range(depth):
                node = 2 * node + 1 + (x[rows, feature[node]] > threshold[node])
            out += value[node - (len(value) - 1)]
        return out


def fit(x: np.ndarray, y: np.ndarray, trees: int = 80, depth: int = 4, rate: float = 0.2, bins: int = 48, penalty: float = 2.0, least: float = 8.0) -> Forest:
    """Second-order boosting of the logistic loss."""
    n, width = x.shape
    cuts = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(cuts[f], x[:, f], "left") for f in range(width)], axis=1)
    share = np.clip(y.mean(), 1e-6, 1 - 1e-6)
    base = float(np.log(share / (1 - share)))
    score = np.full(n, base)
    inner, leaves = 2**depth - 1, 2**depth
    features, thresholds, values = np.zeros((trees, inner), np.int64), np.full((trees, inner), np.inf), np.zeros((trees, leaves))
    # All features' histograms in one count: features are blocks of bins, and empty bins at a block's end split nothing.
    size = max((len(c) for c in cuts), default=0) + 1
    offset = binned + np.arange(width) * size
    last = np.arange(size - 1)[None, :] >= np.array([len(c) for c in cuts])[:, None]
    for t in range(trees):
        p = 1 / (1 + np.exp(-score))
        gradient, hessian = p - y, p * (1 - p)
        wide = [np.repeat(x, width) for x in (gradient, hessian)]
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, count = 2**level - 1, 2**level
            key = ((node - first)[:, None] * (width * size) + offset).reshape(-1)
            g, h = (np.bincount(key, x, count * width * size).reshape(count, width, size) for x in wide)
            gl, hl = np.cumsum(g, 2)[:, :, :-1], np.cumsum(h, 2)[:, :, :-1]
            gt, ht = g.sum(2, keepdims=True), h.sum(2, keepdims=True)
            gain = gl**2 / (hl + penalty) + (gt - gl) ** 2 / (ht - hl + penalty) - gt**2 / (ht + penalty)
            gain[(hl < least / 8) | (ht - hl < least / 8) | last] = -1
            gain = gain.reshape(count, -1)
            at = gain.argmax(1)
            for k in np.flatnonzero(gain[np.arange(count), at] > 1e-6):
                f, cut = divmod(int(at[k]), size - 1)
                features[t, first + k], thresholds[t, first + k] = f, cuts[f][cut]
            node = 2 * node + 1 + (x[np.arange(n), features[t, node]] > thresholds[t, node])
        leaf = node - inner
        g, h = np.bincount(leaf, gradient, leaves), np.bincount(leaf, hessian, leaves)
        values[t] = -rate * g / (h + penalty)
        score += values[t, leaf]
    return Forest(base, features, thresholds, values)
