"""Gradient-boosted trees in numpy: histogram training with monotonic constraints, flat node arrays for scoring."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class FlatTrees:
    """All trees' nodes one after another; a leaf points at itself, so every row takes ``depth`` steps."""

    base: float
    depth: int = 0
    roots: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    feature: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    threshold: np.ndarray = field(default_factory=lambda: np.empty(0))
    left: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    right: np.ndarray = field(default_factory=lambda: np.empty(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.empty(0))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities for the rows of ``x``."""
        total = np.full(len(x), self.base)
        rows = np.arange(len(x))[:, None]
        if len(self.roots):
            node = np.tile(self.roots, (len(x), 1))
            for _ in range(self.depth):
                goes_left = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(goes_left, self.left[node], self.right[node])
            total += self.value[node].sum(axis=1)
        return 1 / (1 + np.exp(-total))


def fit_trees(x: np.ndarray, y: np.ndarray, signs: np.ndarray, trees: int = 60, depth: int = 4, rate: float = 0.15,
              bins: int = 64, penalty: float = 1.0, least_weight: float = 1.0) -> FlatTrees:
    """Boosted trees for logistic loss. ``signs``: +1 or -1 where the score may only rise or fall with a feature, else 0.

    A split against a sign is not made, and children may not pass the middle of a signed split's two
    values, so the whole model is monotonic. One class (or no rows) gives a constant.
    """
    share = (y.sum() + 0.5) / (len(y) + 1.0)
    model = FlatTrees(float(np.log(share / (1 - share))), depth)
    if not len(y) or y.min() == y.max():
        return model
    edges = [np.unique(np.quantile(col, np.linspace(0, 1, bins + 1)[1:-1])) for col in x.T]
    codes = np.stack([np.searchsorted(e, col, side="left") for e, col in zip(edges, x.T)], axis=1)
    raw = np.full(len(y), model.base)
    roots, nodes = [], []  # node: [feature, threshold, left, right, value]

    def leaf_value(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + penalty), low, high))

    for _ in range(trees):
        p = 1 / (1 + np.exp(-raw))
        grad, hess = p - y, p * (1 - p)
        roots.append(len(nodes))
        nodes.append([0, 0.0, len(nodes), len(nodes), 0.0])
        stack = [(roots[-1], np.arange(len(y)), 0, -np.inf, np.inf)]
        while stack:
            at, rows, level, low, high = stack.pop()
            g, h = grad[rows].sum(), hess[rows].sum()
            value = leaf_value(g, h, low, high)
            best = (1e-6, None)
            if level < depth:
                for f, cut in enumerate(edges):
                    if not len(cut):
                        continue
                    own = codes[rows, f]
                    gl = np.cumsum(np.bincount(own, grad[rows], len(cut) + 1))[:-1]
                    hl = np.cumsum(np.bincount(own, hess[rows], len(cut) + 1))[:-1]
                    gr, hr = g - gl, h - hl
                    wl, wr = np.clip(-gl / (hl + penalty), low, high), np.clip(-gr / (hr + penalty), low, high)
                    gain = -(gl * wl + (hl + penalty) * wl**2 / 2) - (gr * wr + (hr + penalty) * wr**2 / 2)
                    gain += g * value + (h + penalty) * value**2 / 2
                    gain[(hl < least_weight) | (hr < least_weight) | (signs[f] * (wr - wl) < 0)] = -np.inf
                    k = int(gain.argmax())
                    if gain[k] > best[0]:
                        best = (float(gain[k]), (f, k, float(wl[k]), float(wr[k])))
            if best[1] is None:
                nodes[at][4] = rate * value
                raw[rows] += rate * value
                continue
            f, k, wl, wr = best[1]
            goes_left = codes[rows, f] <= k
            middle = (wl + wr) / 2
            bounds = {0: ((low, high), (low, high)), 1: ((low, middle), (middle, high)), -1: ((middle, high), (low, middle))}
            l, r = len(nodes), len(nodes) + 1
            nodes[at][:4] = [f, float(edges[f][k]), l, r]
            nodes += [[0, 0.0, l, l, 0.0], [0, 0.0, r, r, 0.0]]
            for child, part, (a, b) in zip((l, r), (rows[goes_left], rows[~goes_left]), bounds[int(signs[f])]):
                stack.append((child, part, level + 1, a, b))
    columns = list(zip(*nodes))
    model.roots = np.array(roots, np.int32)
    model.feature, model.left, model.right = (np.array(columns[i], np.int32) for i in (0, 2, 3))
    model.threshold, model.value = np.array(columns[1]), np.array(columns[4])
    return model
