"""SetSketch: mergeable, locality-sensitive registers of a set (O. Ertl, 2021).

Every element is a Poisson process: its k-th point comes an exponential time after the one before and falls on a random
register. A register's first point over all elements is then an exponential minimum, and it is stored as the truncated
logarithm to a base close to 1. Points come in rising order, so a large set is done after about one point an element:
nothing later can lower a register. The registers of a union are the maxima of the registers, and two registers agree
with a probability close to the Jaccard similarity.
"""

from __future__ import annotations

import math

import numpy as np

from millrace.llm.words import mix

BASE_B = 1.001
RATE_A = 20.0
TOP_Q = 2**16 - 2
STEP = np.uint64(0xD1342543DE82EF95)
PIECE = 1 << 14  # elements at a time


def registers(elements: np.ndarray, m: int) -> np.ndarray:
    """The m registers of a set of 64-bit hashes, as 16-bit integers."""
    first = np.full(m, np.inf)
    for at in range(0, len(elements), PIECE):
        x = elements[at : at + PIECE]
        t = np.zeros(len(x))
        k = math.ceil(m * (math.log(m) + 1) / len(x))  # about what fills all registers
        number = np.uint64(1)
        while len(x):
            steps = number + np.arange(k, dtype=np.uint64)
            random = mix(x[:, None] + steps * STEP)
            times = t[:, None] + np.cumsum(np.log(((random >> np.uint64(24)) + 0.5) * 2.0**-40) / -m, axis=1)
            register = ((random & np.uint64(0xFFFFFF)) * np.uint64(m)) >> np.uint64(24)
            np.minimum.at(first, register.astype(np.int64).ravel(), times.ravel())
            t = times[:, -1]
            going = t < first.max()
            x, t = x[going], t[going]
            number += np.uint64(k)
    if not len(elements):
        return np.zeros(m, np.uint16)
    return np.clip(np.floor(1 - np.log(first / RATE_A) / math.log(BASE_B)), 0, TOP_Q + 1).astype(np.uint16)


def merged(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The registers of the union."""
    return np.maximum(a, b)


def similarity(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray) -> np.ndarray:
    """Jaccard similarities by maximum likelihood, one for each row of registers a and b with their set sizes.

    The numbers of registers that are larger in a, larger in b and equal are trinomial; their probabilities follow from
    the similarity and the sizes. The log-likelihood is concave, so its maximum is found by a ternary search.
    """
    m = a.shape[1]
    more, less = (a > b).sum(1), (a < b).sum(1)
    same = m - more - less
    u, v = n_a / (n_a + n_b), n_b / (n_a + n_b)
    low, high = np.zeros(len(a)), np.minimum(u / v, v / u)

    def share(x: np.ndarray) -> np.ndarray:
        return -np.log1p(-x * (BASE_B - 1) / BASE_B) / math.log(BASE_B)

    def likelihood(j: np.ndarray) -> np.ndarray:
        p, q = share(np.maximum(u - v * j, 0)), share(np.maximum(v - u * j, 0))
        tiny = 1e-300
        return (
            more * np.log(np.maximum(p, tiny)) + less * np.log(np.maximum(q, tiny))
            + same * np.log(np.maximum(1 - p - q, tiny))
        )

    for _ in range(40):
        third = (high - low) / 3
        x, y = low + third, high - third
        left = likelihood(x) < likelihood(y)
        low, high = np.where(left, x, low), np.where(left, high, y)
    return (low + high) / 2


def bands(values: np.ndarray, rows: int) -> np.ndarray:
    """A signed 64-bit key for each run of ``rows`` registers, different from band to band."""
    grid = values[: len(values) // rows * rows].reshape(-1, rows).astype(np.uint64)
    key = np.arange(1, len(grid) + 1, dtype=np.uint64) * STEP
    for column in grid.T:
        key = mix(key + column + np.uint64(1))
    return key.view(np.int64)


def banding(threshold: float, miss: float = 1e-6, most_bands: int = 40) -> tuple[int, int]:
    """Registers a band and bands, so that a pair at the threshold shares no band with a probability of at most ``miss``;
    the longest bands of which not more than ``most_bands`` are needed."""
    rows, count = 1, 1
    for r in range(1, 20):
        needed = math.ceil(math.log(miss) / math.log1p(-(threshold**r)))
        if needed > most_bands and r > 1:
            break
        rows, count = r, needed
    return rows, count
