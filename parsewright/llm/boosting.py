"""Gradient-boosted trees for a few classes, on binned features; small enough to be fitted on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 32


@dataclass
class Tree:
    """A tree of fixed depth in heap order: node i has the children 2i + 1 and 2i + 2."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray

    def predict(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int32)
        rows = np.arange(len(x))
        for _ in range(int(np.log2(len(self.value)))):
            node = 2 * node + 1 + (x[rows, self.feature[node]] > self.threshold[node])
        return self.value[node - len(self.feature)]


class BoostedTrees:
    """Softmax boosting with Newton leaves. ``temperature`` divides the scores; ``calibrate`` fits it on held-out rows."""

    def __init__(self, classes: list[str], rounds: int = 40, depth: int = 3, rate: float = 0.2, penalty: float = 1.0):
        self.classes, self.rounds, self.depth, self.rate, self.penalty = classes, rounds, depth, rate, penalty
        self.trees: list[list[Tree]] = []
        self.base = np.zeros(len(classes))
        self.temperature = 1.0

    def fit(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """``y`` holds class numbers. Classes weigh alike, however many rows they have."""
        n, k = len(x), len(self.classes)
        edges = [np.unique(np.quantile(x[:, j], np.linspace(0, 1, BINS + 1)[1:-1])) for j in range(x.shape[1])]
        binned = np.column_stack([np.searchsorted(e, x[:, j], "left") for j, e in enumerate(edges)]).astype(np.int32)
        counts = np.bincount(y, minlength=k)
        weight = (n / (k * np.maximum(counts, 1)))[y]
        target = np.eye(k)[y]
        scores = np.zeros((n, k))
        for _ in range(self.rounds):
            e = np.exp(scores - scores.max(1, keepdims=True))
            p = e / e.sum(1, keepdims=True)
            layer = []
            for c in range(k):
                tree = self._tree(binned, edges, weight * (target[:, c] - p[:, c]), weight * p[:, c] * (1 - p[:, c]))
                scores[:, c] += self.rate * tree.predict(x)
                layer.append(tree)
            self.trees.append(layer)
        return self

    def _tree(self, binned: np.ndarray, edges: list[np.ndarray], g: np.ndarray, h: np.ndarray) -> Tree:
        inner = 2**self.depth - 1
        feature, threshold = np.zeros(inner, np.int32), np.full(inner, np.inf)
        node = np.zeros(len(g), np.int32)
        for level in range(self.depth):
            first = 2**level - 1
            width = 2**level
            local = node - first
            best = np.zeros(width)
            cut = np.zeros(width, np.int32)
            total_g, total_h = np.bincount(local, g, width), np.bincount(local, h, width)
            for j, e in enumerate(edges):
                if not len(e):
                    continue
                size = len(e) + 1
                code = local * size + binned[:, j]
                gl = np.bincount(code, g, width * size).reshape(width, size).cumsum(1)[:, :-1]
                hl = np.bincount(code, h, width * size).reshape(width, size).cumsum(1)[:, :-1]
                gr, hr = total_g[:, None] - gl, total_h[:, None] - hl
                gain = gl**2 / (hl + self.penalty) + gr**2 / (hr + self.penalty) - (total_g**2 / (total_h + self.penalty))[:, None]
                gain[(hl < 1e-3) | (hr < 1e-3)] = 0
                at = gain.argmax(1)
                better = gain[np.arange(width), at] > best + 1e-9
                best = np.where(better, gain[np.arange(width), at], best)
                cut = np.where(better, at, cut)
                feature[first : first + width] = np.where(better, j, feature[first : first + width])
            for w in range(width):
                if best[w] > 0:
                    threshold[first + w] = edges[feature[first + w]][cut[w]]
            f = feature[node]
            upper = np.array([cut[w] if best[w] > 0 else BINS * 2 for w in range(width)])
            node = 2 * node + 1 + (binned[np.arange(len(g)), f] > upper[local])
        leaf = node - inner
        value = np.bincount(leaf, g, 2**self.depth) / (np.bincount(leaf, h, 2**self.depth) + self.penalty)
        return Tree(feature, threshold, value)

    def scores(self, x: np.ndarray) -> np.ndarray:
        out = np.tile(self.base, (len(x), 1))
        for layer in self.trees:
            for c, tree in enumerate(layer):
                out[:, c] += self.rate * tree.predict(x)
        return out

    def probabilities(self, x: np.ndarray) -> np.ndarray:
        s = self.scores(x) / self.temperature
        e = np.exp(s - s.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)

    def calibrate(self, x: np.ndarray, y: np.ndarray) -> BoostedTrees:
        """Temperature that makes held-out labels likeliest."""
        s = self.scores(x)

        def loss(t: float) -> float:
            z = s / t
            z = z - z.max(1, keepdims=True)
            return float(-(z[np.arange(len(y)), y] - np.log(np.exp(z).sum(1))).mean())

        self.temperature = min(np.geomspace(0.3, 10, 60), key=loss)
        return self
