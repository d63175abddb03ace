"""Gradient-boosted trees for a yes/no target, in numpy: small, deterministic, picklable."""

from __future__ import annotations

import numpy as np


class Boosted:
    """Logistic boosting of shallow regression trees over binned features.

    ``fit`` keeps a fifth of the rows aside and fits on it a sigmoid of the trees' sum (Platt),
    so that ``probability`` is calibrated.
    """

    def __init__(self, rounds: int = 60, depth: int = 3, rate: float = 0.2, bins: int = 32, ridge: float = 1.0, seed: int = 11):
        self.rounds, self.depth, self.rate, self.bins, self.ridge, self.seed = rounds, depth, rate, bins, ridge, seed
        self.trees: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.scale, self.shift = 1.0, 0.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        rng = np.random.default_rng(self.seed)
        aside = rng.random(len(y)) < 0.2
        if len(set(y[~aside])) < 2 or len(set(y[aside])) < 2:
            aside[:] = False
        self._boost(x[~aside], y[~aside].astype(float))
        if aside.any():
            self._calibrate(self.margin(x[aside]), y[aside].astype(float))
        return self

    def _boost(self, x: np.ndarray, y: np.ndarray) -> None:
        n, m = x.shape
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)]
        binned = np.stack([np.searchsorted(edges[j], x[:, j], side="left") for j in range(m)], axis=1)
        f = np.zeros(n)
        size = (1 << self.depth) - 1
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            g, h = y - p, np.maximum(p * (1 - p), 1e-6)
            feature, cut, leaf = np.full(size, -1), np.zeros(size), np.zeros(size + 1 + size)
            at = np.zeros(n, np.int64)
            for node in range(size):
                mine = at == node
                if not mine.any():
                    continue
                best = (1e-6, -1, 0)
                gs, hs = g[mine].sum(), h[mine].sum()
                base = gs**2 / (hs + self.ridge)
                for j in range(m):
                    k = len(edges[j])
                    if not k:
                        continue
                    b = binned[mine, j]
                    gl = np.cumsum(np.bincount(b, g[mine], k + 1))[:-1]
                    hl = np.cumsum(np.bincount(b, h[mine], k + 1))[:-1]
                    gain = gl**2 / (hl + self.ridge) + (gs - gl) ** 2 / (hs - hl + self.ridge) - base
                    i = int(gain.argmax())
                    if gain[i] > best[0]:
                        best = (gain[i], j, i)
                if best[1] < 0:
                    continue
                _, j, i = best
                feature[node], cut[node] = j, edges[j][i]
                at[mine] = 2 * node + 1 + (binned[mine, j] > i)
            for node in np.unique(at):
                mine = at == node
                leaf[node] = self.rate * g[mine].sum() / (h[mine].sum() + self.ridge)
            f += leaf[at]
            self.trees.append((feature, cut, leaf))

    def _calibrate(self, f: np.ndarray, y: np.ndarray) -> None:
        a, b = 1.0, 0.0
        pos, neg = y.sum(), len(y) - y.sum()
        target = np.where(y > 0, (pos + 1) / (pos + 2), 1 / (neg + 2))
        for _ in range(50):
            p = 1 / (1 + np.exp(-(a * f + b)))
            w = np.maximum(p * (1 - p), 1e-6)
            grad = np.array([((target - p) * f).sum() - 1e-3 * (a - 1), (target - p).sum()])
            hess = np.array([[(w * f * f).sum() + 1e-3, (w * f).sum()], [(w * f).sum(), w.sum() + 1e-3]])
            step = np.linalg.solve(hess, grad)
            a, b = a + step[0], b + step[1]
            if np.abs(step).max() < 1e-6:
                break
        self.scale, self.shift = max(a, 1e-3), b

    def margin(self, x: np.ndarray) -> np.ndarray:
        f = np.zeros(len(x))
        rows = np.arange(len(x))
        for feature, cut, leaf in self.trees:
            at = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                inner = at < len(feature)
                j = np.where(inner, feature[np.minimum(at, len(feature) - 1)], -1)
                go = j >= 0
                right = x[rows, np.maximum(j, 0)] > cut[np.minimum(at, len(feature) - 1)]
                at = np.where(go, 2 * at + 1 + right, at)
            f += leaf[at]
        return f

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-(self.scale * self.margin(x) + self.shift)))
