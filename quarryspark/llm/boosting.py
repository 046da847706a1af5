"""Gradient-boosted trees for small tables of features, as arrays."""

from __future__ import annotations

import numpy as np


class BoostedTrees:
    """Depth-limited regression trees fitted to the logistic loss, one after another; scores are probabilities."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.3, least: int = 8):
        self.trees, self.depth, self.rate, self.least = trees, depth, rate, least

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        self.prior = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
        self.cuts = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, 17)[1:-1])) for j in range(x.shape[1])]
        margin, self.model = np.full(len(y), self.prior), []
        for _ in range(self.trees):
            p = 1 / (1 + np.exp(-margin))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.model.append(tree)
            margin += self._walk(tree, x)
        return self

    def _grow(self, x, g, h, rows, depth):
        leaf = float(self.rate * g[rows].sum() / (h[rows].sum() + 1.0))
        if not depth or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        total_g, total_h = g[rows].sum(), h[rows].sum()
        base = total_g**2 / (total_h + 1.0)
        for j, cuts in enumerate(self.cuts):
            for c in cuts:
                left = x[rows, j] <= c
                n = int(left.sum())
                if n < self.least or len(rows) - n < self.least:
                    continue
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                gain = gl**2 / (hl + 1.0) + (total_g - gl) ** 2 / (total_h - hl + 1.0) - base
                if gain > best[0]:
                    best = (gain, j, float(c))
        if best[1] is None:
            return leaf
        left = x[rows, best[1]] <= best[2]
        return (best[1], best[2], self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1))

    def _walk(self, tree, x: np.ndarray) -> np.ndarray:
        if not isinstance(tree, tuple):
            return np.full(len(x), tree)
        j, c, low, high = tree
        left, out = x[:, j] <= c, np.empty(len(x))
        out[left], out[~left] = self._walk(low, x[left]), self._walk(high, x[~left])
        return out

    def margin(self, x: np.ndarray) -> np.ndarray:
        return self.prior + sum((self._walk(t, x) for t in self.model), np.zeros(len(x)))

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-self.margin(x)))


def platt(margin: np.ndarray, y: np.ndarray, steps: int = 200) -> tuple[float, float]:
    """a, b so that 1 / (1 + exp(-(a * margin + b))) is calibrated on held-out rows."""
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = 1 / (1 + np.exp(-(a * margin + b)))
        w = p * (1 - p) + 1e-6
        g = np.array([((y - p) * margin).sum(), (y - p).sum()])
        hess = np.array([[(w * margin * margin).sum() + 1e-3, (w * margin).sum()], [(w * margin).sum(), w.sum() + 1e-3]])
        a, b = np.array([a, b]) + 0.5 * np.linalg.solve(hess, g)
    return float(a), float(b)


def threshold(p: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The least probability at and above which held-out precision holds; above 1 if none does."""
    order = np.argsort(-p, kind="stable")
    good = np.cumsum(y[order]) / np.arange(1, len(y) + 1) >= precision
    return float(p[order][np.flatnonzero(good)[-1]]) if good.any() else 1.1
