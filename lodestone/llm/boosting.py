"""Gradient-boosted trees on a bounded training table (numpy, on the driver) and isotonic calibration."""

from __future__ import annotations

import numpy as np

BINS = 64


class Trees:
    """Complete binary trees of one depth as arrays: the feature and threshold of each node, the value of each leaf."""

    def __init__(self, bias: float, feature: np.ndarray, threshold: np.ndarray, value: np.ndarray):
        self.bias, self.feature, self.threshold, self.value = bias, feature, threshold, value

    def margin(self, x: np.ndarray) -> np.ndarray:
        """Log-odds of each row of ``x``."""
        trees = np.arange(len(self.value))
        if not len(trees):
            return np.full(len(x), self.bias)
        depth = self.value.shape[1].bit_length() - 1
        node = np.zeros((len(x), len(trees)), np.int64)
        rows = np.arange(len(x))[:, None]
        for _ in range(depth):
            node = 2 * node + 1 + (x[rows, self.feature[trees, node]] > self.threshold[trees, node])
        return self.bias + self.value[trees, node - (self.value.shape[1] - 1)].sum(1)


def fitted(x: np.ndarray, y: np.ndarray, rounds: int = 80, depth: int = 3, rate: float = 0.15, ridge: float = 1.0, least: int = 10) -> Trees:
    """Second-order boosting of the logistic loss over histograms of ``BINS`` bins; fixed by its input alone."""
    positive = min(max(float(y.mean()) if len(y) else 0.0, 1e-4), 1 - 1e-4)
    bias = float(np.log(positive / (1 - positive)))
    if not len(y) or y.min() == y.max():
        return Trees(bias, np.zeros((0, 1), int), np.zeros((0, 1)), np.zeros((0, 2)))
    n, width = x.shape
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(width)]
    bins = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], 1)  # value <= edge: that bin or lower
    inner, leaves = (1 << depth) - 1, 1 << depth
    feature, threshold, value = np.zeros((rounds, inner), np.int64), np.full((rounds, inner), np.inf), np.zeros((rounds, leaves))
    margin = np.full(n, bias)
    for tree in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        slope, bend = p - y, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            first, many = (1 << level) - 1, 1 << level
            at = node - first
            best = np.full(many, 1e-6)
            for f in range(width):
                size = len(edges[f]) + 1
                if size < 2:
                    continue
                cell = at * size + bins[:, f]
                g, h, c = (np.bincount(cell, weights=w, minlength=many * size).reshape(many, size) for w in (slope, bend, None))
                left_g, left_h, left_c = np.cumsum(g, 1)[:, :-1], np.cumsum(h, 1)[:, :-1], np.cumsum(c, 1)[:, :-1]
                all_g, all_h, all_c = g.sum(1, keepdims=True), h.sum(1, keepdims=True), c.sum(1, keepdims=True)
                gain = left_g**2 / (left_h + ridge) + (all_g - left_g) ** 2 / (all_h - left_h + ridge) - all_g**2 / (all_h + ridge)
                gain[(left_c < least) | (all_c - left_c < least)] = -1
                where = gain.argmax(1)
                top = gain[np.arange(many), where]
                for k in np.nonzero(top > best)[0]:
                    best[k], feature[tree, first + k], threshold[tree, first + k] = top[k], f, edges[f][where[k]]
            node = 2 * node + 1 + (x[np.arange(n), feature[tree, node]] > threshold[tree, node])
        leaf = node - inner
        g, h = np.bincount(leaf, weights=slope, minlength=leaves), np.bincount(leaf, weights=bend, minlength=leaves)
        value[tree] = -rate * g / (h + ridge)
        margin += value[tree, leaf]
    return Trees(bias, feature, threshold, value)


class Isotonic:
    """A non-decreasing map from margins to probabilities: pooled adjacent violators, linear between the pools."""

    def __init__(self, margin: np.ndarray, y: np.ndarray):
        pools: list[list[float]] = []  # margin sum, label sum, weight
        values, own = np.unique(margin, return_inverse=True)  # rows of equal margins are one pool from the start
        labels, weights = np.bincount(own, weights=y, minlength=len(values)), np.bincount(own, minlength=len(values))
        for m, label, weight in zip(values.tolist(), labels.tolist(), weights.tolist(), strict=True):
            pools.append([m * weight, label, float(weight)])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                last = pools.pop()
                pools[-1] = [a + b for a, b in zip(pools[-1], last, strict=True)]
        self.at = np.array([p[0] / p[2] for p in pools])
        # One imagined label of each kind in each pool keeps probabilities off 0 and 1.
        self.to = np.maximum.accumulate([(p[1] + 0.5) / (p[2] + 1) for p in pools]) if pools else np.empty(0)

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        return np.interp(margin, self.at, self.to) if len(self.at) else 1 / (1 + np.exp(-margin))
