"""Gradient-boosted trees on a bounded sample that sits on the driver.

Training data here is always a sample of documented size; scoring happens in
Spark, either as compiled column expressions or on batches inside tasks.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


@dataclass
class Tree:
    """Nodes in arrays; a leaf has feature -1."""

    feature: list[int] = field(default_factory=list)
    threshold: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    value: list[float] = field(default_factory=list)

    def new(self, value: float) -> int:
        for column, start in ((self.feature, -1), (self.threshold, 0.0), (self.left, -1), (self.right, -1), (self.value, value)):
            column.append(start)
        return len(self.feature) - 1

    def predict(self, rows: np.ndarray) -> np.ndarray:
        """The leaf value of each row, all rows one level at a time."""
        feature, threshold = np.array(self.feature), np.array(self.threshold)
        left, right = np.array(self.left), np.array(self.right)
        at = np.zeros(len(rows), np.int64)
        each = np.arange(len(rows))
        while True:
            inner = feature[at] >= 0
            if not inner.any():
                return np.array(self.value)[at]
            low = rows[each, np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(low, left[at], right[at]), at)

    def paths(self) -> list[tuple[tuple[int, str, float], ...]]:
        """The conjunction of tests that leads to each node below the root."""
        found, open_ = [], [(0, ())]
        while open_:
            node, tests = open_.pop()
            if tests:
                found.append(tests)
            if self.feature[node] >= 0:
                f, t = self.feature[node], self.threshold[node]
                open_ += [(self.left[node], (*tests, (f, "<=", t))), (self.right[node], (*tests, (f, ">", t)))]
        return found


@dataclass
class Boosted:
    start: float
    trees: list[Tree]

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.start)
        for tree in self.trees:
            total += tree.predict(rows)
        return sigmoid(total)


def boost(rows: np.ndarray, labels: np.ndarray, trees: int = 40, depth: int = 3, rate: float = 0.25, bins: int = 64, least: int = 10, ridge: float = 1.0) -> Boosted:
    """Logistic boosting with second-order gains over histogram bins."""
    n, width = rows.shape
    if n == 0:
        return Boosted(0.0, [])
    edges = [np.unique(np.quantile(rows[:, f], np.linspace(0, 1, bins + 1)[1:-1])) for f in range(width)]
    codes = np.stack([np.searchsorted(edges[f], rows[:, f], side="left") for f in range(width)])
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    start = float(np.log(share / (1 - share)))
    total, made = np.full(n, start), []
    for _ in range(trees):
        p = sigmoid(total)
        slope, bend = p - labels, p * (1 - p)
        tree = Tree()
        open_ = [(tree.new(0.0), np.arange(n), 0)]
        while open_:
            node, at, level = open_.pop()
            g, h = slope[at], bend[at]
            gs, hs = g.sum(), h.sum()
            tree.value[node] = float(-rate * gs / (hs + ridge))
            best = (1e-6, -1, 0)
            if level < depth and len(at) >= 2 * least:
                for f in range(width):
                    k = len(edges[f]) + 1
                    if k < 2:
                        continue
                    c = codes[f, at]
                    gl, hl = np.cumsum(np.bincount(c, g, k))[:-1], np.cumsum(np.bincount(c, h, k))[:-1]
                    nl = np.cumsum(np.bincount(c, minlength=k))[:-1]
                    gain = gl**2 / (hl + ridge) + (gs - gl) ** 2 / (hs - hl + ridge) - gs**2 / (hs + ridge)
                    gain[(nl < least) | (len(at) - nl < least)] = 0
                    b = int(gain.argmax())
                    if gain[b] > best[0]:
                        best = (float(gain[b]), f, b)
            if best[1] >= 0:
                _, f, b = best
                low = codes[f, at] <= b
                tree.feature[node], tree.threshold[node] = f, float(edges[f][b])
                tree.left[node], tree.right[node] = tree.new(0.0), tree.new(0.0)
                open_ += [(tree.left[node], at[low], level + 1), (tree.right[node], at[~low], level + 1)]
        made.append(tree)
        total += tree.predict(rows)
    return Boosted(start, made)


def lasso_logistic(rules: np.ndarray, labels: np.ndarray, penalty: float, steps: int = 400) -> tuple[float, np.ndarray]:
    """Intercept and sparse weights of an L1-penalised logistic fit, by accelerated proximal steps."""
    n, k = rules.shape
    share = min(max(labels.mean(), 1e-3), 1 - 1e-3)
    bias, weights = float(np.log(share / (1 - share))), np.zeros(k)
    if n == 0 or k == 0:
        return bias, weights
    step = 4.0 * n / (np.linalg.norm(np.c_[np.ones(n), rules], 2) ** 2)
    ahead, ahead_bias, t = weights.copy(), bias, 1.0
    for _ in range(steps):
        error = sigmoid(rules @ ahead + ahead_bias) - labels
        moved = ahead - step * (rules.T @ error) / n
        new = np.sign(moved) * np.maximum(np.abs(moved) - step * penalty, 0)
        new_bias = ahead_bias - step * error.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        ahead, ahead_bias = new + (t - 1) / t_new * (new - weights), new_bias + (t - 1) / t_new * (new_bias - bias)
        weights, bias, t = new, new_bias, t_new
    return float(bias), weights
