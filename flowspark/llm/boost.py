"""Gradient-boosted trees and isotonic calibration in NumPy, for models fitted on a bounded sample in one process."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Binary classifier: trees of fixed depth over binned features, fitted by Newton steps on the logistic loss."""

    def __init__(self, trees: int = 60, depth: int = 4, rate: float = 0.2, bins: int = 24, least: float = 8.0, ridge: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.least, self.ridge = trees, depth, rate, bins, least, ridge

    def fit(self, x: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None) -> Boosted:
        n, k = x.shape
        w = np.ones(n) if weight is None else weight.astype(np.float64)
        self.edges = []
        b = np.empty((n, k), np.int64)
        for j in range(k):
            v = np.unique(x[:, j])
            e = (v[1:] + v[:-1]) / 2 if len(v) <= self.bins else np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1]))
            self.edges.append(e)
            b[:, j] = np.searchsorted(e, x[:, j], side="left")
        size = self.bins + 1
        # most features have one frequent bin: its sums are what the other rows of a node leave
        usual = [int(np.bincount(b[:, j], minlength=size).argmax()) for j in range(k)]
        rows = [np.flatnonzero(b[:, j] != usual[j]) for j in range(k)]
        bins = [b[r, j] for j, r in enumerate(rows)]
        p = np.clip((w * y).sum() / max(w.sum(), 1e-9), 1e-4, 1 - 1e-4)
        self.base = float(np.log(p / (1 - p)))
        f = np.full(n, self.base)
        m = 2**self.depth
        self.feature, self.cut, self.leaf = np.zeros((self.trees, m), np.int64), np.full((self.trees, m), size), np.zeros((self.trees, m))
        for t in range(self.trees):
            q = 1 / (1 + np.exp(-f))
            g, h = w * (y - q), w * q * (1 - q)
            node = np.ones(n, np.int64)
            for depth in range(self.depth):
                first, count = 2**depth, 2**depth
                best, at, cut = np.zeros(count), np.zeros(count, np.int64), np.full(count, size)
                gn, hn = np.bincount(node - first, g, count), np.bincount(node - first, h, count)
                for j in range(k):
                    key = (node[rows[j]] - first) * size + bins[j]
                    gs = np.bincount(key, g[rows[j]], count * size).reshape(count, size)
                    hs = np.bincount(key, h[rows[j]], count * size).reshape(count, size)
                    gs[:, usual[j]], hs[:, usual[j]] = gn - gs.sum(1), hn - hs.sum(1)
                    gs, hs = gs.cumsum(1), hs.cumsum(1)
                    gt, ht = gs[:, -1:], hs[:, -1:]
                    gain = gs**2 / (hs + self.ridge) + (gt - gs) ** 2 / (ht - hs + self.ridge) - gt**2 / (ht + self.ridge)
                    gain[(hs < self.least / 8) | (ht - hs < self.least / 8)] = 0
                    i = gain.argmax(1)
                    v = gain[np.arange(count), i]
                    better = v > best + 1e-9
                    best[better], at[better], cut[better] = v[better], j, i[better]
                self.feature[t, first : 2 * first], self.cut[t, first : 2 * first] = at, cut
                node = 2 * node + (b[np.arange(n), self.feature[t, node]] > self.cut[t, node])
            leaf = node - m
            self.leaf[t] = self.rate * np.bincount(leaf, g, m) / (np.bincount(leaf, h, m) + self.ridge)
            f += self.leaf[t][leaf]
        return self

    def margin(self, x: np.ndarray) -> np.ndarray:
        n = len(x)
        b = np.stack([np.searchsorted(e, x[:, j], side="left") for j, e in enumerate(self.edges)], 1) if n else np.zeros((0, x.shape[1]), np.int64)
        f, rows = np.full(n, self.base), np.arange(n)
        for t in range(self.trees):
            node = np.ones(n, np.int64)
            for _ in range(self.depth):
                node = 2 * node + (b[rows, self.feature[t, node]] > self.cut[t, node])
            f += self.leaf[t][node - 2**self.depth]
        return f


class Isotonic:
    """Monotone step function from scores to probabilities, by pooling adjacent violators."""

    def fit(self, score: np.ndarray, y: np.ndarray) -> Isotonic:
        order = np.argsort(score, kind="stable")
        s, v = score[order], y[order].astype(np.float64)
        value: list[float] = []
        weight: list[float] = []
        start: list[float] = []
        for a, b in zip(s.tolist(), v.tolist()):
            value.append(b)
            weight.append(1.0)
            start.append(a)
            while len(value) > 1 and (value[-2] >= value[-1] or start[-2] == start[-1]):
                w = weight[-2] + weight[-1]
                value[-2:] = [(value[-2] * weight[-2] + value[-1] * weight[-1]) / w]
                weight[-2:] = [w]
                start.pop()
        self.start, self.value = np.array(start), np.array(value)
        return self

    def predict(self, score: np.ndarray) -> np.ndarray:
        if not len(self.value):
            return np.zeros(len(score))
        return self.value[np.clip(np.searchsorted(self.start, score, side="right") - 1, 0, None)]
