"""Gradient-boosted trees on small whole-number features, with thresholds calibrated on held-out cases."""

from __future__ import annotations

import numpy as np


class Trees:
    """Logistic boosting with shallow trees; scores are kept per feature tuple, of which there are few."""

    def __init__(self, rounds: int = 60, depth: int = 4, rate: float = 0.25, least: float = 2.0) -> None:
        self.rounds, self.depth, self.rate, self.least = rounds, depth, rate, least
        self.trees: list = []
        self.base, self.threshold = 0.0, 0.5
        self.seen: dict[tuple, float] = {}

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        self.base = float(np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3)))
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grow(x, y - p, p * (1 - p), np.arange(len(y)), self.depth)
            self.trees.append(tree)
            f += self.rate * np.array([self._walk(tree, r) for r in np.unique(x, axis=0, return_inverse=True)[0]])[self._index(x)]
        return self

    def stored(self) -> dict:
        """Everything that scoring needs, for a file; leaves are rounded."""

        def rounded(tree):
            return round(tree, 5) if isinstance(tree, float) else [tree[0], tree[1], rounded(tree[2]), rounded(tree[3])]

        return {"base": self.base, "rate": self.rate, "threshold": self.threshold, "trees": [rounded(t) for t in self.trees]}

    @classmethod
    def restored(cls, stored: dict) -> Trees:
        def tree(x):
            return (x[0], x[1], tree(x[2]), tree(x[3])) if isinstance(x, list) else float(x)

        out = cls(rate=stored["rate"])
        out.base, out.threshold, out.trees = stored["base"], stored["threshold"], [tree(t) for t in stored["trees"]]
        return out

    @staticmethod
    def _index(x: np.ndarray) -> np.ndarray:
        return np.unique(x, axis=0, return_inverse=True)[1].reshape(-1)

    def _grow(self, x: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(gs / (hs + 1.0))
        if depth == 0:
            return leaf
        best, cut = 1e-6, None
        for k in range(x.shape[1]):
            v = x[rows, k]
            for t in np.unique(v)[:-1]:
                left = v <= t
                gl, hl = g[rows][left].sum(), h[rows][left].sum()
                if min(left.sum(), len(rows) - left.sum()) < self.least:
                    continue
                gain = gl * gl / (hl + 1) + (gs - gl) ** 2 / (hs - hl + 1) - gs * gs / (hs + 1)
                if gain > best:
                    best, cut = gain, (k, int(t), left)
        if cut is None:
            return leaf
        k, t, left = cut
        return k, t, self._grow(x, g, h, rows[left], depth - 1), self._grow(x, g, h, rows[~left], depth - 1)

    @staticmethod
    def _walk(tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, row: tuple) -> float:
        """Probability of a feature tuple."""
        s = self.seen.get(row)
        if s is None:
            if len(self.seen) > 100_000:
                self.seen.clear()
            f = self.base + self.rate * sum(self._walk(t, row) for t in self.trees)
            s = self.seen[row] = float(1 / (1 + np.exp(-f)))
        return s

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> Trees:
        """The threshold of the best F1 on held-out cases; the middle of the range where several are best."""
        s = np.array([self.score(tuple(r)) for r in x.tolist()])
        grid = np.linspace(0.05, 0.95, 19)
        f1 = [2 * (hit := ((s >= t) & (y == 1)).sum()) / max(1, (s >= t).sum() + (y == 1).sum()) for t in grid]
        self.threshold = float(np.median(grid[np.array(f1) >= max(f1) - 1e-9]))
        return self

    def accepts(self, row: tuple) -> bool:
        return self.score(row) >= self.threshold
