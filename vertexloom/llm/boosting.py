"""Gradient-boosted trees that become SQL expressions.

Training is small and runs on the driver in numpy; scoring is a sum of nested
conditions over columns, so it stays inside the query plan.
"""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    """A leaf (``feature`` is None) or a split ``feature <= threshold``."""

    value: float = 0.0
    feature: int | None = None
    threshold: float = 0.0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, grad: np.ndarray, hess: np.ndarray, depth: int, l2: float) -> Node:
    g, h = grad.sum(), hess.sum()
    leaf = Node(value=float(g / (h + l2)))
    if depth == 0 or len(x) < 8:
        return leaf
    best = (1e-6, None, 0.0)
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, cg, ch = x[order, f], np.cumsum(grad[order]), np.cumsum(hess[order])
        cut = np.flatnonzero(v[1:] > v[:-1])
        if not len(cut):
            continue
        gain = cg[cut] ** 2 / (ch[cut] + l2) + (g - cg[cut]) ** 2 / (h - ch[cut] + l2) - g * g / (h + l2)
        k = int(np.argmax(gain))
        if gain[k] > best[0]:
            best = (float(gain[k]), f, float((v[cut[k]] + v[cut[k] + 1]) / 2))
    if best[1] is None:
        return leaf
    left = x[:, best[1]] <= best[2]
    return Node(0.0, best[1], best[2], _grow(x[left], grad[left], hess[left], depth - 1, l2), _grow(x[~left], grad[~left], hess[~left], depth - 1, l2))


def _predict(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature is None:
        return np.full(len(x), node.value)
    left = x[:, node.feature] <= node.threshold
    out = np.empty(len(x))
    out[left], out[~left] = _predict(node.low, x[left]), _predict(node.high, x[~left])
    return out


@dataclass
class Boosted:
    """An additive model of log-odds."""

    names: list[str]
    base: float
    rate: float
    trees: list[Node]

    def decision(self, x: np.ndarray) -> np.ndarray:
        return self.base + self.rate * sum(_predict(t, x) for t in self.trees)

    def column(self, features: Mapping[str, Column]) -> Column:
        """The log-odds over columns named as the features."""

        def of(node: Node) -> Column:
            if node.feature is None:
                return F.lit(round(node.value * self.rate, 6))
            return F.when(features[self.names[node.feature]] <= F.lit(node.threshold), of(node.low)).otherwise(of(node.high))

        total = F.lit(self.base)
        for t in self.trees:
            total = total + of(t)
        return total


def fit(x: np.ndarray, y: np.ndarray, names: list[str], trees: int = 20, depth: int = 3, rate: float = 0.4, l2: float = 1.0) -> Boosted:
    """Fit by Newton boosting on logistic loss; deterministic."""
    p = float(np.clip(y.mean(), 1e-3, 1 - 1e-3))
    model = Boosted(names, float(np.log(p / (1 - p))), rate, [])
    score = np.full(len(x), model.base)
    for _ in range(trees):
        q = 1 / (1 + np.exp(-score))
        tree = _grow(x, y - q, q * (1 - q), depth, l2)
        model.trees.append(tree)
        score += rate * _predict(tree, x)
    return model


def threshold_for(score: np.ndarray, y: np.ndarray, precision: float) -> float:
    """The limit, midway between two scores, above which the share of positives is at least ``precision`` on calibration rows."""
    order = np.argsort(-score, kind="stable")
    s, hits = score[order], np.cumsum(y[order])
    ok = np.flatnonzero((hits / np.arange(1, len(s) + 1) >= precision) & np.append(s[1:] < s[:-1], True))
    if not len(ok):
        return float("inf")
    last = int(ok[-1])
    return float((s[last] + s[last + 1]) / 2) if last + 1 < len(s) else float(s[last]) - 1
