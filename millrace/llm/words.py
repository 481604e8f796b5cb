"""Word and shingle hashes of whole texts with numpy.

Words are runs of bytes of one class in the UTF-8 text. Their hashes are differences of polynomial prefix sums modulo
2^64, so a text costs a few array operations whatever its number of words. Long texts go in pieces of about ``LIMIT``
bytes cut between words, which bounds the memory; a single word beyond that is hashed by itself.
"""

from __future__ import annotations

import hashlib

import numpy as np

SPACES = bytes([0x20, *range(0x09, 0x0E)])
BASE = 0x9E3779B97F4A7C15  # odd, so it has an inverse modulo 2^64
LIMIT = 1 << 18


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values (the public splitmix64 finaliser)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def byte_table(members: bytes, inverted: bool = False) -> np.ndarray:
    table = np.zeros(256, np.int8)
    table[list(members)] = 1
    return 1 - table if inverted else table


WORD_BYTES = byte_table(SPACES, inverted=True)


def spans(data: np.ndarray, table: np.ndarray = WORD_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends (exclusive) of the runs of bytes the table marks."""
    edge = np.diff(table[data], prepend=np.int8(0), append=np.int8(0))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


class Hasher:
    """Word hashes and rolling hashes over them; holds the tables of powers."""

    def __init__(self, limit: int = LIMIT):
        self.limit = limit
        self.powers = self._powers(BASE)
        self.inverses = self._powers(pow(BASE, -1, 1 << 64))

    def _powers(self, base: int) -> np.ndarray:
        out = np.full(self.limit + 1, base, np.uint64)
        out[0] = 1
        return np.cumprod(out)

    def words(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """A 64-bit hash of every span."""
        out = np.empty(len(starts), np.uint64)
        i = 0
        while i < len(starts):
            low = starts[i]
            j = max(i + 1, int(np.searchsorted(ends, low + self.limit, "right")))
            high = ends[j - 1]
            if high - low > self.limit:
                digest = hashlib.blake2b(data[low:high].tobytes(), digest_size=8).digest()
                out[i] = int.from_bytes(digest, "little")
            else:
                sums = np.zeros(high - low + 1, np.uint64)
                np.cumsum((data[low:high] + np.uint64(1)) * self.powers[: high - low], out=sums[1:])
                s, e = starts[i:j] - low, ends[i:j] - low
                out[i:j] = mix((sums[e] - sums[s]) * self.inverses[s])
            i = j
        return out

    def grams(self, words: np.ndarray, n: int) -> np.ndarray:
        """Hashes of the runs of n words, one for each start; none if there are fewer words."""
        count = len(words) - n + 1
        if count <= 0:
            return np.empty(0, np.uint64)
        out = np.zeros(count, np.uint64)
        for j in range(n):
            out += words[j : j + count] * self.powers[j + 1]
        return mix(out)

    def shingles(self, text: bytes, n: int) -> np.ndarray:
        """The sorted distinct n-word shingles of a text, letters A-Z in lower case; with fewer words the whole sequence
        is one shingle; none without words."""
        data = np.frombuffer(text.lower(), np.uint8)
        words = self.words(data, *spans(data))
        if not len(words):
            return words
        return np.unique(self.grams(words, min(n, len(words))))
