"""Gradient-boosted trees with monotone constraints, kept as flat numpy node arrays."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass(frozen=True)
class FlatTrees:
    """All trees in one set of node arrays; ``roots`` are the numbers of their first nodes.

    A leaf points at itself, so every row takes the same number of steps and scoring needs
    no branches.
    """

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    roots: np.ndarray
    depth: int
    bias: float

    def margin(self, x: np.ndarray) -> np.ndarray:
        total = np.full(len(x), self.bias)
        rows = np.arange(len(x))
        for root in self.roots:
            node = np.full(len(x), root)
            for _ in range(self.depth):
                below = x[rows, self.feature[node]] <= self.threshold[node]
                node = np.where(below, self.left[node], self.right[node])
            total += self.value[node]
        return total

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1.0 / (1.0 + np.exp(-self.margin(x)))


def fit_trees(x: np.ndarray, y: np.ndarray, constraints: dict[int, int] | None = None, trees: int = 60, depth: int = 4, rate: float = 0.15, bins: int = 64, ridge: float = 1.0, least: float = 5.0) -> FlatTrees:
    """Fit to the log loss of labels ``y`` (0 or 1).

    ``constraints`` maps a feature to +1 (the score must not fall as it rises) or -1. A split
    that would break one is not taken, and the middle of its two values bounds what lies below.
    """
    constraints = constraints or {}
    n, width = x.shape
    positive = np.clip(y.mean() if n else 0.5, 1e-3, 1 - 1e-3)
    bias = float(np.log(positive / (1 - positive)))
    nodes: list[list] = []  # feature, threshold, left, right, value
    roots: list[int] = []
    if not n:
        nodes.append([0, np.inf, 0, 0, 0.0])
        return FlatTrees(*_columns(nodes), np.array([0]), depth, bias)
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    binned = np.stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    sign = np.array([constraints.get(f, 0) for f in range(width)])
    margin = np.full(n, bias)
    for _ in range(trees):
        p = 1.0 / (1.0 + np.exp(-margin))
        grad, hess = p - y, np.maximum(p * (1 - p), 1e-6)
        roots.append(len(nodes))
        _grow(nodes, binned, edges, grad, hess, sign, depth, rate, bins, ridge, least, margin)
    return FlatTrees(*_columns(nodes), np.array(roots), depth, bias)


def _columns(nodes: list[list]) -> tuple[np.ndarray, ...]:
    kinds = (np.int64, np.float64, np.int64, np.int64, np.float64)
    return tuple(np.array(c, k) for c, k in zip(zip(*nodes), kinds))


def _grow(nodes, binned, edges, grad, hess, sign, depth, rate, bins, ridge, least, margin) -> None:
    width = binned.shape[1]

    def leaf(g: float, h: float, low: float, high: float) -> float:
        return float(np.clip(-g / (h + ridge), low, high))

    def add(rows: np.ndarray, level: int, low: float, high: float) -> int:
        me = len(nodes)
        g, h = grad[rows].sum(), hess[rows].sum()
        nodes.append([0, np.inf, me, me, 0.0])
        best = None
        if level < depth and len(rows) >= 2 * least:
            cells = binned[rows] + np.arange(width) * bins
            gs = np.bincount(cells.ravel(), np.repeat(grad[rows], width), width * bins).reshape(width, bins).cumsum(1)
            hs = np.bincount(cells.ravel(), np.repeat(hess[rows], width), width * bins).reshape(width, bins).cumsum(1)
            ns = np.bincount(cells.ravel(), minlength=width * bins).reshape(width, bins).cumsum(1)
            lv = np.clip(-gs / (hs + ridge), low, high)
            rv = np.clip(-(g - gs) / (h - hs + ridge), low, high)
            gain = gs**2 / (hs + ridge) + (g - gs) ** 2 / (h - hs + ridge) - g**2 / (h + ridge)
            bad = (ns < least) | (len(rows) - ns < least) | (sign[:, None] * (rv - lv) < 0)
            gain[bad] = 0.0
            f, b = np.unravel_index(int(gain.argmax()), gain.shape)
            if gain[f, b] > 1e-6 and b < len(edges[f]):
                best = (int(f), int(b), lv[f, b], rv[f, b])
        if best is None:
            nodes[me][4] = rate * leaf(g, h, low, high)
            margin[rows] += nodes[me][4]
            return me
        f, b, lv, rv = best
        here = binned[rows, f] <= b
        bounds = [(low, high), (low, high)]
        if sign[f]:
            middle = (lv + rv) / 2
            bounds = [(low, middle), (middle, high)] if sign[f] > 0 else [(middle, high), (low, middle)]
        nodes[me][0], nodes[me][1] = f, float(edges[f][b])
        nodes[me][2] = add(rows[here], level + 1, *bounds[0])
        nodes[me][3] = add(rows[~here], level + 1, *bounds[1])
        return me

    add(np.arange(len(grad)), 0, -np.inf, np.inf)
