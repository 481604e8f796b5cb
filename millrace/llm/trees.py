"""A small classification tree for small labelled tables."""

from __future__ import annotations

import numpy as np


def _impurity(ones: np.ndarray, total: np.ndarray) -> np.ndarray:
    share = ones / np.maximum(total, 1)
    return total * share * (1 - share)


def fit_tree(x: np.ndarray, y: np.ndarray, depth: int) -> tuple:
    """Nested (feature, threshold, left, right) by Gini impurity, leaves are the share of ones; ties go to the first
    feature and the lowest threshold."""
    if depth == 0 or y.min() == y.max():
        return (float(y.mean()),)
    best = None
    for f in range(x.shape[1]):
        order = np.argsort(x[:, f], kind="stable")
        v, ones = x[order, f], np.cumsum(y[order])
        cuts = np.flatnonzero(v[1:] > v[:-1])
        if not len(cuts):
            continue
        n = cuts + 1
        cost = _impurity(ones[cuts], n) + _impurity(ones[-1] - ones[cuts], len(y) - n)
        at = int(np.argmin(cost))
        if best is None or cost[at] < best[0] - 1e-12:
            best = (cost[at], f, (v[cuts[at]] + v[cuts[at] + 1]) / 2)
    if best is None:
        return (float(y.mean()),)
    _, f, threshold = best
    low = x[:, f] <= threshold
    return f, float(threshold), fit_tree(x[low], y[low], depth - 1), fit_tree(x[~low], y[~low], depth - 1)


def predict(tree: tuple, row: tuple) -> float:
    while len(tree) == 4:
        tree = tree[2] if row[tree[0]] <= tree[1] else tree[3]
    return tree[0]
