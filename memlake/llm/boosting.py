"""Gradient-boosted trees over a bounded table of feature patterns.

Features are small integers, so all rows of a corpus reduce to a table of
patterns with their positive and negative counts.  Spark counts it over all
rows; the trees are fitted on the counts and come back as column expressions.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


class Trees:
    """Logistic boosting with trees of depth two to three on integer features."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.3, penalty: float = 1.0):
        self.rounds, self.depth, self.rate, self.penalty = rounds, depth, rate, penalty
        self.base, self.trees = 0.0, []

    def fit(self, x: np.ndarray, positive: np.ndarray, negative: np.ndarray) -> "Trees":
        """``x``: one row a pattern; weights are the counts of either label."""
        total = positive + negative
        share = (positive.sum() + 1.0) / (total.sum() + 2.0)
        self.base = float(np.log(share / (1 - share)))
        margin = np.full(len(x), self.base)
        for _ in range(self.rounds if len(x) else 0):
            p = 1 / (1 + np.exp(-margin))
            grad, hess = positive - total * p, total * p * (1 - p)
            tree = self._grow(x, grad, hess, np.arange(len(x)), self.depth)
            self.trees.append(tree)
            margin += np.array([self._value(tree, row) for row in x])
        return self

    def _grow(self, x, grad, hess, rows, depth):
        g, h = grad[rows].sum(), hess[rows].sum()
        best = (1e-6, None, None)
        if depth:
            for f in range(x.shape[1]):
                values = x[rows, f]
                for cut in np.unique(values)[:-1]:
                    left = rows[values <= cut]
                    gl, hl = grad[left].sum(), hess[left].sum()
                    gain = (gl * gl / (hl + self.penalty) + (g - gl) ** 2 / (h - hl + self.penalty)
                            - g * g / (h + self.penalty))
                    if gain > best[0]:
                        best = (gain, f, int(cut))
        _, f, cut = best
        if f is None:
            return float(self.rate * g / (h + self.penalty))
        low = x[rows, f] <= cut
        return (f, cut, self._grow(x, grad, hess, rows[low], depth - 1),
                self._grow(x, grad, hess, rows[~low], depth - 1))

    def _value(self, tree, row) -> float:
        while isinstance(tree, tuple):
            tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
        return tree

    def score(self, x: np.ndarray) -> np.ndarray:
        margin = np.array([self.base + sum(self._value(t, row) for t in self.trees) for row in x])
        return 1 / (1 + np.exp(-margin))

    def column(self, features: list[Column]) -> Column:
        """The probability as an expression of the feature columns."""
        def build(tree) -> Column:
            if not isinstance(tree, tuple):
                return F.lit(tree)
            return F.when(features[tree[0]] <= tree[1], build(tree[2])).otherwise(build(tree[3]))
        margin = F.lit(self.base)
        for tree in self.trees:
            margin = margin + build(tree)
        return F.lit(1.0) / (F.lit(1.0) + F.exp(-margin))


def precise_threshold(score: np.ndarray, positive: np.ndarray, negative: np.ndarray, precision: float) -> float:
    """Lowest score above which at least ``precision`` of the weight is positive; over 1 if there is none."""
    order = np.argsort(-score, kind="stable")
    hits, all_ = np.cumsum(positive[order]), np.cumsum((positive + negative)[order])
    ends = np.append(score[order][1:] != score[order][:-1], True) if len(score) else np.array([], bool)
    good = np.flatnonzero(ends & (all_ > 0) & (hits >= precision * all_))
    return float(score[order][good[-1]]) if len(good) else 2.0
