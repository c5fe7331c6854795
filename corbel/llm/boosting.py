"""Gradient-boosted trees of fixed depth on a bounded sample, scored by array lookups."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


class BoostedTrees:
    """Logistic loss, histogram splits, complete trees: node k has children 2k+1 and 2k+2."""

    def __init__(self, trees: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, l2: float = 1.0):
        self.trees, self.depth, self.rate, self.bins, self.l2 = trees, depth, rate, bins, l2

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        n, f = x.shape
        inner = 2**self.depth - 1
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(f)]
        code = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(f)], axis=1)
        self.feature = np.zeros((self.trees, inner), np.int64)
        self.cut = np.full((self.trees, inner), np.inf)
        self.leaf = np.zeros((self.trees, inner + 1))
        share = np.clip(y.mean(), 1e-3, 1 - 1e-3)
        self.start = float(np.log(share / (1 - share)))
        score = np.full(n, self.start)
        for t in range(self.trees):
            p = sigmoid(score)
            g, h = y - p, p * (1 - p)
            node = np.zeros(n, np.int64)
            for k in range(inner):
                at = np.flatnonzero(node == k)
                best = 1e-6
                base = g[at].sum() ** 2 / (h[at].sum() + self.l2)
                for j in range(f) if len(at) > 1 else ():
                    size = len(edges[j]) + 1
                    gs = np.cumsum(np.bincount(code[at, j], g[at], size))[:-1]
                    hs = np.cumsum(np.bincount(code[at, j], h[at], size))[:-1]
                    gain = gs**2 / (hs + self.l2) + (g[at].sum() - gs) ** 2 / (h[at].sum() - hs + self.l2) - base
                    if len(gain) and gain.max() > best:
                        best, self.feature[t, k] = gain.max(), j
                        self.cut[t, k] = edges[j][gain.argmax()]
                node[at] = 2 * k + 1 + (x[at, self.feature[t, k]] > self.cut[t, k])
            end = node - inner
            self.leaf[t] = self.rate * np.bincount(end, g, inner + 1) / (np.bincount(end, h, inner + 1) + self.l2)
            score += self.leaf[t, end]
        return self

    def score(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.start)
        for t in range(self.trees):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[np.arange(len(x)), self.feature[t, node]] > self.cut[t, node])
            out += self.leaf[t, node - (2**self.depth - 1)]
        return out


def platt(score: np.ndarray, y: np.ndarray, steps: int = 60) -> tuple[float, float]:
    """a, b of the calibrated probability sigmoid(a * score + b), by Newton steps with smoothed targets."""
    pos, neg = y.sum(), len(y) - y.sum()
    target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
    a, b = 1.0, 0.0
    for _ in range(steps):
        p = sigmoid(a * score + b)
        d, w = p - target, p * (1 - p) + 1e-9
        g = np.array([(d * score).sum(), d.sum()])
        m = np.array([[(w * score * score).sum() + 1e-6, (w * score).sum()], [(w * score).sum(), w.sum() + 1e-6]])
        a, b = np.array([a, b]) - np.linalg.solve(m, g)
    return float(a), float(b)
