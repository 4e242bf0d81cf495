"""Gradient-boosted trees for a few classes on a bounded sample, in numpy, with calibrated probabilities."""

from __future__ import annotations

import numpy as np


class Boosted:
    """One additive model of shallow trees a class (logistic loss), scores turned to probabilities by softmax.

    Splits are sought over quantile bins with regularised second-order gains. calibrate() fits a temperature and a bias a
    class on a holdout by gradient descent. A class without examples keeps a constant low score.
    """

    def __init__(self, classes: tuple[str, ...], rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32, least: float = 4.0, l2: float = 1.0) -> None:
        self.classes, self.rounds, self.depth, self.rate, self.bins, self.least, self.l2 = classes, rounds, depth, rate, bins, least, l2
        self.temperature, self.bias = 1.0, np.zeros(len(classes))

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        n, m = x.shape if x.ndim == 2 else (0, 0)
        self.edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, self.bins + 1)[1:-1])) for j in range(m)] if n else []
        binned = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if n else np.zeros((0, 0), int)
        self.start, self.trees = [], []
        for c in self.classes:
            t = (y == c).astype(float) if n else np.zeros(0)
            p = np.clip(t.mean() if n else 0.0, 1e-3, 1 - 1e-3)
            score, trees = np.full(n, np.log(p / (1 - p))), []
            self.start.append(float(np.log(p / (1 - p))))
            for _ in range(self.rounds if 0 < t.sum() < n else 0):
                q = 1 / (1 + np.exp(-score))
                tree = self._tree(binned, q - t, q * (1 - q), np.arange(n), self.depth)
                score += self.rate * self._apply(tree, binned)
                trees.append(tree)
            self.trees.append(trees)
        return self

    def _tree(self, b: np.ndarray, g: np.ndarray, h: np.ndarray, rows: np.ndarray, depth: int):
        gs, hs = g[rows].sum(), h[rows].sum()
        leaf = float(-gs / (hs + self.l2))
        if depth == 0 or len(rows) < 2 * self.least:
            return leaf
        best = (1e-6, None, None)
        for j, edges in enumerate(self.edges):
            if not len(edges):
                continue
            k = len(edges) + 1
            gl = np.cumsum(np.bincount(b[rows, j], g[rows], k))[:-1]
            hl = np.cumsum(np.bincount(b[rows, j], h[rows], k))[:-1]
            nl = np.cumsum(np.bincount(b[rows, j], minlength=k))[:-1]
            gain = gl**2 / (hl + self.l2) + (gs - gl) ** 2 / (hs - hl + self.l2) - gs**2 / (hs + self.l2)
            gain[(nl < self.least) | (len(rows) - nl < self.least)] = -1
            i = int(gain.argmax())
            if gain[i] > best[0]:
                best = (float(gain[i]), j, i)
        if best[1] is None:
            return leaf
        left = b[rows, best[1]] <= best[2]
        return best[1], best[2], self._tree(b, g, h, rows[left], depth - 1), self._tree(b, g, h, rows[~left], depth - 1)

    def _apply(self, tree, b: np.ndarray) -> np.ndarray:
        if isinstance(tree, float):
            return np.full(len(b), tree)
        j, i, low, high = tree
        return np.where(b[:, j] <= i, self._apply(low, b), self._apply(high, b))

    def scores(self, x: np.ndarray) -> np.ndarray:
        b = np.stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(self.edges)], 1) if len(self.edges) else np.zeros((len(x), 0), int)
        out = np.zeros((len(x), len(self.classes)))
        for k, trees in enumerate(self.trees):
            out[:, k] = self.start[k] + self.rate * sum((self._apply(t, b) for t in trees), np.zeros(len(x)))
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        z = self.scores(x) / self.temperature + self.bias
        e = np.exp(z - z.max(1, keepdims=True)) if len(z) else z
        return e / e.sum(1, keepdims=True) if len(z) else z

    def calibrate(self, x: np.ndarray, y: np.ndarray, steps: int = 400, rate: float = 0.05, prior: float = 0.5) -> Boosted:
        """Temperature and biases of least log loss; prior pulls the biases to 0, for holdouts are small."""
        s, t = self.scores(x), (y[:, None] == np.array(self.classes, object)[None, :]).astype(float)
        a, bias = 0.0, np.zeros(len(self.classes))
        for _ in range(steps if len(s) else 0):
            z = s * np.exp(a) + bias
            e = np.exp(z - z.max(1, keepdims=True))
            d = e / e.sum(1, keepdims=True) - t
            a -= rate * float((d * s).sum() / len(s) * np.exp(a))
            bias -= rate * (d.mean(0) + prior * bias / len(s))
            a = float(np.clip(a, -3, 3))
        self.temperature, self.bias = float(np.exp(-a)), bias
        return self
