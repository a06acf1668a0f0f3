"""Gradient-boosted trees for a few classes, in numpy."""

from __future__ import annotations

import numpy as np

BINS = 32


class Boosted:
    """Softmax boosting with histogram trees of fixed depth.

    Features are cut into at most ``BINS`` quantile bins; every node of a level is split by
    the bin that gains most under the second-order loss. Ties take the first feature and bin.
    """

    def __init__(self, classes: int, rounds: int = 40, depth: int = 5, rate: float = 0.25,
                 share: float = 0.5, ridge: float = 1.0, seed: int = 42):
        self.classes, self.rounds, self.depth, self.rate = classes, rounds, depth, rate
        self.share, self.ridge, self.seed = share, ridge, seed
        self.edges: list[np.ndarray] = []
        self.trees: list[tuple[int, np.ndarray, np.ndarray, np.ndarray]] = []

    def _binned(self, x: np.ndarray) -> np.ndarray:
        out = np.empty(x.shape, np.uint8)
        for j, edges in enumerate(self.edges):
            out[:, j] = np.searchsorted(edges, x[:, j], side="right")
        return out

    def fit(self, x: np.ndarray, y: np.ndarray) -> Boosted:
        marks = np.linspace(0, 1, BINS)[1:-1]
        self.edges = [np.unique(np.quantile(column, marks)) for column in x.T]
        binned, rng = self._binned(x), np.random.default_rng(self.seed)
        scores = np.zeros((len(x), self.classes))
        target = np.eye(self.classes)[y]
        for _ in range(self.rounds):
            p = np.exp(scores - scores.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for c in range(self.classes):
                used = np.sort(rng.permutation(x.shape[1])[: max(1, int(self.share * x.shape[1]))])
                tree = self._grow(binned, p[:, c] - target[:, c], p[:, c] * (1 - p[:, c]), used)
                self.trees.append((c, *tree))
                scores[:, c] += self._leaf(binned, *tree)
        return self

    def _grow(self, binned, grad, hess, used):
        inner = 2**self.depth - 1
        feature, cut = np.zeros(inner, np.int64), np.full(inner, BINS, np.int64)
        at = np.zeros(len(binned), np.int64)
        for level in range(self.depth):
            base, width = 2**level - 1, 2**level
            local = at - base
            best = np.full(width, 1e-6)
            for j in used:
                key = local * BINS + binned[:, j]
                g = np.bincount(key, grad, width * BINS).reshape(width, BINS).cumsum(1)
                h = np.bincount(key, hess, width * BINS).reshape(width, BINS).cumsum(1)
                gr, hr = g[:, -1:] - g, h[:, -1:] - h
                whole = g[:, -1:] ** 2 / (h[:, -1:] + self.ridge)
                gain = g**2 / (h + self.ridge) + gr**2 / (hr + self.ridge) - whole
                gain[:, -1] = 0
                top = gain.argmax(1)
                value = gain[np.arange(width), top]
                better = value > best
                best[better] = value[better]
                feature[base : base + width][better] = j
                cut[base : base + width][better] = top[better]
            at = 2 * at + 1 + (binned[np.arange(len(binned)), feature[at]] > cut[at])
        leaf = at - inner
        g = np.bincount(leaf, grad, 2**self.depth)
        h = np.bincount(leaf, hess, 2**self.depth)
        return feature, cut, -self.rate * g / (h + self.ridge)

    def _leaf(self, binned, feature, cut, value):
        at, rows = np.zeros(len(binned), np.int64), np.arange(len(binned))
        for _ in range(self.depth):
            at = 2 * at + 1 + (binned[rows, feature[at]] > cut[at])
        return value[at - len(feature)]

    def log_p(self, x: np.ndarray) -> np.ndarray:
        """Log probabilities, rows x classes."""
        binned, scores = self._binned(x), np.zeros((len(x), self.classes))
        for c, *tree in self.trees:
            scores[:, c] += self._leaf(binned, *tree)
        scores -= scores.max(1, keepdims=True)
        return scores - np.log(np.exp(scores).sum(1, keepdims=True))
