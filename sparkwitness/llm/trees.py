"""Small tree ensembles in NumPy: a random forest and gradient boosting.

Features are cut into at most ``BINS`` bins by quantiles; a tree is grown level
by level from histograms of gradient and weight, and is stored as a complete
binary tree, so that prediction is a few array look-ups for all rows at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

BINS = 64


@dataclass
class Ensemble:
    """Trees as arrays (tree, node); a row goes right where its value exceeds the threshold."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    depth: int
    base: float

    def raw(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))
        for t in range(len(self.feature)):
            node = np.zeros(len(x), np.int64)
            for _ in range(self.depth):
                node = 2 * node + 1 + (x[rows, self.feature[t][node]] > self.threshold[t][node])
            total += self.value[t][node]
        return total


def _edges(x: np.ndarray) -> list[np.ndarray]:
    cuts = []
    for f in range(x.shape[1]):
        values = np.unique(x[:, f])
        middle = (values[1:] + values[:-1]) / 2
        if len(middle) > BINS - 1:
            middle = middle[np.linspace(0, len(middle) - 1, BINS - 1).astype(int)]
        cuts.append(middle)
    return cuts


def _grow(binned: np.ndarray, cuts: list[np.ndarray], g: np.ndarray, h: np.ndarray, depth: int, least: float, per_split: int, ridge: float, rng: np.random.Generator):
    nodes = 2 ** (depth + 1) - 1
    feature, threshold, value = np.zeros(nodes, np.int32), np.full(nodes, np.inf), np.zeros(nodes)
    place = np.zeros(len(g), np.int64)
    for level in range(depth):
        first, count = 2**level - 1, 2**level
        local = place - first
        best = np.zeros(count)
        total_g = np.bincount(local, g, minlength=count)
        total_h = np.bincount(local, h, minlength=count)
        whole = total_g**2 / (total_h + ridge)
        allowed = np.ones((count, binned.shape[1]), bool)
        if per_split < binned.shape[1]:
            allowed = rng.random((count, binned.shape[1])).argsort(axis=1) < per_split
        for f in range(binned.shape[1]):
            if not len(cuts[f]) or not allowed[:, f].any():
                continue
            at = local * BINS + binned[:, f]
            left_g = np.bincount(at, g, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)[:, :-1]
            left_h = np.bincount(at, h, minlength=count * BINS).reshape(count, BINS).cumsum(axis=1)[:, :-1]
            right_g, right_h = total_g[:, None] - left_g, total_h[:, None] - left_h
            gain = left_g**2 / (left_h + ridge) + right_g**2 / (right_h + ridge) - whole[:, None]
            gain[(left_h < least) | (right_h < least)] = 0
            gain[:, len(cuts[f]) :] = 0
            cut = gain.argmax(axis=1)
            top = gain[np.arange(count), cut]
            better = (top > best + 1e-12) & allowed[:, f]
            best[better] = top[better]
            feature[first : first + count][better] = f
            threshold[first : first + count][better] = cuts[f][cut[better]]
        low = np.array([np.searchsorted(cuts[feature[first + i]], threshold[first + i], "left") if np.isfinite(threshold[first + i]) else BINS for i in range(count)])
        right = binned[np.arange(len(g)), feature[place]] > low[local]
        place = 2 * place + 1 + right
    last = 2**depth - 1
    local = place - last
    value[last:] = np.bincount(local, g, minlength=2**depth) / (np.bincount(local, h, minlength=2**depth) + ridge)
    return feature, threshold, value, place


def _binned(x: np.ndarray, cuts: list[np.ndarray]) -> np.ndarray:
    return np.column_stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])


def random_forest(x: np.ndarray, y: np.ndarray, trees: int = 48, depth: int = 8, seed: int = 7) -> Ensemble:
    """Bagged trees on 0/1 labels; ``raw`` is the mean share of label 1."""
    rng = np.random.default_rng(seed)
    cuts = _edges(x)
    binned = _binned(x, cuts)
    per_split = max(2, int(np.sqrt(x.shape[1])) + 1)
    grown = []
    for _ in range(trees):
        w = np.bincount(rng.integers(0, len(y), len(y)), minlength=len(y)).astype(float)
        grown.append(_grow(binned, cuts, w * y, w, depth, 2.0, per_split, 1e-6, rng)[:3])
    return Ensemble(np.stack([f for f, _, _ in grown]), np.stack([t for _, t, _ in grown]), np.stack([v for _, _, v in grown]) / trees, depth, 0.0)


def boosted(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.25, seed: int = 7) -> Ensemble:
    """Gradient boosting of the log loss; ``raw`` is the log-odds of label 1."""
    rng = np.random.default_rng(seed)
    cuts = _edges(x)
    binned = _binned(x, cuts)
    base = float(np.log((y.mean() + 1e-6) / (1 - y.mean() + 1e-6)))
    score = np.full(len(y), base)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        f, t, v, place = _grow(binned, cuts, y - p, p * (1 - p), depth, 1.0, x.shape[1], 1.0, rng)
        grown.append((f, t, rate * v))
        score += rate * v[place]
    return Ensemble(np.stack([f for f, _, _ in grown]), np.stack([t for _, t, _ in grown]), np.stack([v for _, _, v in grown]), depth, base)
