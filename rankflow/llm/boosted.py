"""Gradient boosted trees over small integer features, fitted on counts and applied as SQL.

Examples that share all features are one row with two counts, so that the fit takes a table whose
size does not depend on the number of examples. The fitted trees are a plain column expression.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


@dataclass
class Node:
    value: float = 0.0
    feature: int = -1
    at_most: int = 0
    low: Node | None = None
    high: Node | None = None


def _grow(x: np.ndarray, gradient: np.ndarray, hessian: np.ndarray, depth: int, ridge: float) -> Node:
    """The best tree by Newton gain; every feature value is a possible cut."""
    g, h = gradient.sum(), hessian.sum()
    node = Node(value=float(g / (h + ridge)))
    best = 1e-6
    if depth == 0:
        return node
    for f in range(x.shape[1]):
        values, slot = np.unique(x[:, f], return_inverse=True)
        if len(values) < 2:
            continue
        low_g = np.cumsum(np.bincount(slot, gradient))[:-1]
        low_h = np.cumsum(np.bincount(slot, hessian))[:-1]
        gain = low_g**2 / (low_h + ridge) + (g - low_g) ** 2 / (h - low_h + ridge) - g**2 / (h + ridge)
        cut = int(np.argmax(gain))
        if gain[cut] > best:
            best, node.feature, node.at_most = float(gain[cut]), f, int(values[cut])
    if node.feature >= 0:
        low = x[:, node.feature] <= node.at_most
        node.low = _grow(x[low], gradient[low], hessian[low], depth - 1, ridge)
        node.high = _grow(x[~low], gradient[~low], hessian[~low], depth - 1, ridge)
    return node


def tree_values(node: Node, x: np.ndarray) -> np.ndarray:
    if node.feature < 0:
        return np.full(len(x), node.value)
    low = x[:, node.feature] <= node.at_most
    return np.where(low, tree_values(node.low, x), tree_values(node.high, x))


def fit_trees(
    x: np.ndarray, positive: np.ndarray, negative: np.ndarray,
    trees: int = 24, depth: int = 3, rate: float = 0.3, ridge: float = 1.0,
) -> tuple[float, list[Node]]:
    """(base log odds, trees); a row of x stands for its positive and negative examples."""
    n = positive + negative
    base = float(np.log((positive.sum() + 1) / (negative.sum() + 1)))
    logit = np.full(len(x), base)
    grown = []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-logit))
        node = _grow(x, positive - n * p, n * p * (1 - p), depth, ridge)
        if node.feature < 0:
            break
        grown.append(node)
        _scale(node, rate)
        logit += tree_values(node, x)
    return base, grown


def _scale(node: Node, rate: float) -> None:
    node.value *= rate
    for child in (node.low, node.high):
        if child:
            _scale(child, rate)


def _tree_column(node: Node, features: list[Column]) -> Column:
    if node.feature < 0:
        return F.lit(node.value)
    low, high = _tree_column(node.low, features), _tree_column(node.high, features)
    return F.when(features[node.feature] <= node.at_most, low).otherwise(high)


def logit_column(base: float, trees: list[Node], features: list[Column]) -> Column:
    total = F.lit(base)
    for node in trees:
        total = total + _tree_column(node, features)
    return total


def logits(base: float, trees: list[Node], x: np.ndarray) -> np.ndarray:
    return base + sum((tree_values(t, x) for t in trees), np.zeros(len(x)))
