"""Generalised additive model with pairwise interactions, from cyclically boosted shallow trees on binned features."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np


@dataclass
class Additive:
    """An intercept, a lookup table for each feature and for each pair of features, and the bin edges.

    The sum of table entries is a log odds; ``edges`` are upper bounds, so a value goes to the bin of ``searchsorted``.
    """

    intercept: float
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray] = field(default_factory=list)  # edges for the pairs
    pairs: list[tuple[int, int]] = field(default_factory=list)
    pair_tables: list[np.ndarray] = field(default_factory=list)

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probabilities of the rows, by additions of bins."""
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[np.searchsorted(self.edges[f], x[:, f])]
        rough = {f: np.searchsorted(self.coarse[f], x[:, f]) for f in {f for pair in self.pairs for f in pair}}
        for (f, g), table in zip(self.pairs, self.pair_tables):
            total += table[rough[f], rough[g]]
        return 1 / (1 + np.exp(-total))


def _edges(values: np.ndarray, bins: int) -> np.ndarray:
    """Midpoints between neighbouring values at even shares of the rows."""
    distinct = np.unique(values)
    cuts = np.unique(np.searchsorted(distinct, np.quantile(values, np.arange(1, bins) / bins)))
    cuts = cuts[cuts < len(distinct) - 1]
    return (distinct[cuts] + distinct[cuts + 1]) / 2


def _gain(g: np.ndarray, h: np.ndarray, ridge: float) -> np.ndarray:
    return g * g / (h + ridge)


def _line_tree(g: np.ndarray, h: np.ndarray, leaves: int, ridge: float) -> np.ndarray:
    """Leaf values for each bin of a tree that splits an ordered feature into at most ``leaves`` intervals."""
    cg, ch = np.concatenate([[0], np.cumsum(g)]), np.concatenate([[0], np.cumsum(h)])
    cuts = [0, len(g)]
    for _ in range(leaves - 1):
        best = (1e-9, 0)
        for a, b in zip(cuts, cuts[1:]):
            mid = np.arange(a + 1, b)
            if not len(mid):
                continue
            gain = (
                _gain(cg[mid] - cg[a], ch[mid] - ch[a], ridge) + _gain(cg[b] - cg[mid], ch[b] - ch[mid], ridge)
                - _gain(cg[b] - cg[a], ch[b] - ch[a], ridge)
            )
            at = int(np.argmax(gain))
            best = max(best, (float(gain[at]), -int(mid[at])))
        if not best[1]:
            break
        cuts = sorted([*cuts, -best[1]])
    out = np.zeros(len(g))
    for a, b in zip(cuts, cuts[1:]):
        out[a:b] = -(cg[b] - cg[a]) / (ch[b] - ch[a] + ridge)
    return out


def _plane_tree(g: np.ndarray, h: np.ndarray, ridge: float) -> tuple[np.ndarray, float]:
    """Leaf values on a grid and the gain of the tree of depth two that splits each axis once (four quadrants)."""
    cg = np.pad(g.cumsum(0).cumsum(1), ((1, 0), (1, 0)))
    ch = np.pad(h.cumsum(0).cumsum(1), ((1, 0), (1, 0)))

    def quadrants(c: np.ndarray) -> tuple[np.ndarray, ...]:
        low = c[1:-1, 1:-1]
        right, down, all_ = c[1:-1, -1:], c[-1:, 1:-1], c[-1, -1]
        return low, right - low, down - low, all_ - right - down + low

    if min(g.shape) < 2:
        return np.zeros(g.shape), 0.0
    gs, hs = quadrants(cg), quadrants(ch)
    gain = sum(_gain(a, b, ridge) for a, b in zip(gs, hs))
    i, j = np.unravel_index(int(np.argmax(gain)), gain.shape)
    v = [-a[i, j] / (b[i, j] + ridge) for a, b in zip(gs, hs)]
    out = np.empty(g.shape)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = v
    return out, float(gain[i, j])


def fit(
    x: np.ndarray, y: np.ndarray, bins: int = 32, rounds: int = 120, rate: float = 0.1, leaves: int = 3, n_pairs: int = 6,
    pair_bins: int = 8, pair_rounds: int = 40, ridge: float = 1.0,
) -> Additive:
    """Boosts one feature after the other, round by round, each time with a shallow tree on that feature alone, so that
    none takes over what another shares with it. Then the pairs whose quadrants best explain the rest are boosted alike."""
    share = (y.sum() + 0.5) / (len(y) + 1)
    intercept = float(np.log(share / (1 - share)))
    edges = [_edges(x[:, f], bins) if len(x) else np.empty(0) for f in range(x.shape[1])]
    binned = [np.searchsorted(e, x[:, f]) for f, e in enumerate(edges)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    total = np.full(len(y), intercept)

    def slopes() -> tuple[np.ndarray, np.ndarray]:
        p = 1 / (1 + np.exp(-total))
        return p - y, p * (1 - p)

    for _ in range(rounds):
        for f, bin_ in enumerate(binned):
            if len(tables[f]) > 1:
                g, h = (np.bincount(bin_, s, len(tables[f])) for s in slopes())
                step = rate * _line_tree(g, h, leaves, ridge)
                tables[f] += step
                total += step[bin_]
    model = Additive(intercept, edges, tables)
    model.coarse = [_edges(x[:, f], pair_bins) if len(x) else np.empty(0) for f in range(x.shape[1])]
    rough = [np.searchsorted(e, x[:, f]) for f, e in enumerate(model.coarse)]
    sizes = [len(e) + 1 for e in model.coarse]

    def grid(f: int, k: int) -> tuple[np.ndarray, np.ndarray]:
        cell = rough[f] * sizes[k] + rough[k]
        return tuple(np.bincount(cell, s, sizes[f] * sizes[k]).reshape(sizes[f], sizes[k]) for s in slopes())

    every = [(f, k) for f in range(x.shape[1]) for k in range(f + 1, x.shape[1]) if min(sizes[f], sizes[k]) > 1]
    ranked = sorted(every, key=lambda p: (-_plane_tree(*grid(*p), ridge)[1], p))
    model.pairs = ranked[:n_pairs]
    model.pair_tables = [np.zeros((sizes[f], sizes[k])) for f, k in model.pairs]
    for _ in range(pair_rounds):
        for table, (f, k) in zip(model.pair_tables, model.pairs):
            step = rate * _plane_tree(*grid(f, k), ridge)[0]
            table += step
            total += step[rough[f], rough[k]]
    return model
