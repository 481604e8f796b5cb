"""A skip-chain conditional random field over the tokens of documents (Sutton, McCallum, 2004).

Neighbouring tokens share chain potentials, distant tokens that repeat each other or are alike share skip potentials. The
graph has cycles, so marginals come from loopy message passing: all messages of a round are computed at once. Weights follow
the gradient of the likelihood, with the marginals of the same message passing in place of the exact ones.
"""

from __future__ import annotations

import dataclasses
from collections.abc import Sequence

import numpy as np

CHAIN, LOOSE, SAME, ALIKE = range(4)  # kinds of edges: neighbours, neighbours apart, equal tokens, similar tokens
ROUNDS = 12


@dataclasses.dataclass
class Graph:
    """Nodes with binary features (pairs of node and feature number), edges (a, b, kind), and known labels (-1: unknown)."""

    known: np.ndarray
    at: np.ndarray
    feature: np.ndarray
    a: np.ndarray
    b: np.ndarray
    kind: np.ndarray


def joined(graphs: Sequence[Graph]) -> Graph:
    """All graphs as one, without edges between them."""
    sizes = [len(g.known) for g in graphs]
    shift = np.cumsum([0, *sizes])[:-1]

    def together(name: str, moved: bool) -> np.ndarray:
        parts = [getattr(g, name) + (s if moved else 0) for g, s in zip(graphs, shift)]
        return np.concatenate(parts) if parts else np.zeros(0, np.int64)

    return Graph(*(together(f.name, f.name in ("at", "a", "b")) for f in dataclasses.fields(Graph)))


class SkipChain:
    def __init__(self, labels: int, features: int):
        self.labels = labels
        self.single = np.zeros((features, labels))
        self.pair = np.zeros((4, labels, labels))

    def _scores(self, g: Graph) -> np.ndarray:
        n = len(g.known)
        scores = np.stack([np.bincount(g.at, self.single[g.feature, l], n) for l in range(self.labels)], axis=1)
        scores[g.known >= 0] = -40.0
        seen = np.flatnonzero(g.known >= 0)
        scores[seen, g.known[seen]] = 0.0
        return scores

    def marginals(self, g: Graph, rounds: int = ROUNDS, skips: bool = True) -> tuple[np.ndarray, np.ndarray]:
        """Probabilities of labels for nodes, and of pairs of labels for edges. Without ``skips`` a plain chain."""
        if not skips:
            near = g.kind <= LOOSE
            g = dataclasses.replace(g, a=g.a[near], b=g.b[near], kind=g.kind[near])
        n, m = len(g.known), len(g.a)
        scores = self._scores(g)
        source, target = np.concatenate([g.a, g.b]), np.concatenate([g.b, g.a])
        back = np.concatenate([np.arange(m, 2 * m), np.arange(m)])
        force = np.exp(self.pair)
        force = np.concatenate([force[g.kind], force[g.kind].transpose(0, 2, 1)])
        message = np.zeros((2 * m, self.labels))  # logarithms
        belief = scores
        for _ in range(rounds if m else 0):
            away = belief[source] - message[back]
            away = np.exp(away - away.max(1, keepdims=True))
            new = np.einsum("el,elk->ek", away, force)
            new = np.log(new / new.sum(1, keepdims=True))
            change = np.abs(new - message).max()
            message = (message + new) / 2
            belief = scores + np.stack([np.bincount(target, message[:, l], n) for l in range(self.labels)], axis=1)
            if change < 1e-3:
                break
        nodes = np.exp(belief - belief.max(1, keepdims=True)) if n else belief
        nodes = nodes / nodes.sum(1, keepdims=True)
        left, right = belief[g.a] - message[m:], belief[g.b] - message[:m]
        edges = left[:, :, None] + right[:, None, :] + self.pair[g.kind]
        edges = np.exp(edges - edges.max((1, 2), keepdims=True)) if m else edges
        return nodes, edges / edges.sum((1, 2), keepdims=True)

    def fit(self, g: Graph, truth: np.ndarray, steps: int = 90, rate: float = 0.15, ridge: float = 0.02) -> SkipChain:
        """Gradient ascent with a rate for each weight (Adam) on the likelihood of the labels, less a ridge."""
        size = len(truth)
        aim = np.eye(self.labels)[truth]
        pairs = aim[g.a][:, :, None] * aim[g.b][:, None, :]
        free = g.known < 0
        moments = [[np.zeros_like(w), np.zeros_like(w)] for w in (self.single, self.pair)]
        for step in range(1, steps + 1):
            nodes, edges = self.marginals(g, rounds=6)
            off = (aim - nodes) * free[:, None]
            by_feature = np.stack(
                [np.bincount(g.feature, off[g.at, l], len(self.single)) for l in range(self.labels)], axis=1)
            by_kind = np.stack([(pairs - edges)[g.kind == k].sum(0) for k in range(4)])
            by_kind[SAME:] = (by_kind[SAME:] + by_kind[SAME:].transpose(0, 2, 1)) / 2  # skip edges have no direction
            for weight, slope, (mean, square) in zip((self.single, self.pair), (by_feature, by_kind), moments):
                slope = slope / size - ridge * weight / 100
                mean += 0.1 * (slope - mean)
                square += 0.01 * (slope**2 - square)
                weight += rate * (mean / (1 - 0.9**step)) / (np.sqrt(square / (1 - 0.99**step)) + 1e-6)
        return self
