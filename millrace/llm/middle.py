"""Fill-in-the-middle formatting: texts cut at token boundaries that a learned rank index finds.

The index answers "where does token k begin?". The offsets of all boundaries rise almost linearly with their rank, so they
are stored as linear segments (rank of the first boundary, offset, slope) that miss no boundary by more than ``ERROR`` code
points, and the misses themselves as one byte each. A cut is predicted from its segment and corrected by the stored miss,
which makes it exact. One index holds all texts of a slice of rows; no segment crosses a text.
"""

from __future__ import annotations

import dataclasses
import hashlib
import itertools
from collections.abc import Callable, Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.llm.tables import map_parts, text_bytes

ERROR = 100  # most code points by which a segment may miss a boundary; must fit a signed byte


class RankIndex:
    """Boundary offsets by rank, as error-bounded segments and residuals."""

    def __init__(self, offsets: np.ndarray, firsts: np.ndarray, error: int = ERROR):
        """``offsets`` are the boundaries of all texts in a row, ``firsts`` the rank of each text's first boundary.

        A stretch of boundaries takes the line through its first and last one, moved to the middle of the misses; if that
        misses by more than the error, both halves are tried. All stretches of a level are fitted at once."""
        self.size = len(offsets)
        self.residuals = np.zeros(self.size, np.int8)
        made = []
        low, high = firsts, np.append(firsts[1:], self.size)
        low, high = low[high > low], high[high > low]
        while len(low):
            count = high - low
            at = np.cumsum(count) - count
            rank = np.arange(count.sum()) - np.repeat(at - low, count)
            slope = (offsets[high - 1] - offsets[low]) / np.maximum(count - 1, 1)
            miss = offsets[rank] - self._line(rank, np.repeat(low, count), np.repeat(offsets[low], count), np.repeat(slope, count))
            least, most = np.minimum.reduceat(miss, at), np.maximum.reduceat(miss, at)
            good = most - least <= 2 * error
            middle = (least + most) // 2
            made.append((low[good], offsets[low][good] + middle[good], slope[good]))
            kept = np.repeat(good, count)
            self.residuals[rank[kept]] = (miss - np.repeat(middle, count))[kept]
            half = (low + high)[~good] // 2
            low, high = np.concatenate([low[~good], half]), np.concatenate([half, high[~good]])
        starts, bases, slopes = (np.concatenate(x) for x in zip(*made)) if made else (np.zeros(0, np.int64),) * 3
        order = np.argsort(starts)
        self.starts, self.bases, self.slopes = starts[order], bases[order], slopes[order]

    @staticmethod
    def _line(rank: np.ndarray, start: np.ndarray, base: np.ndarray, slope: np.ndarray) -> np.ndarray:
        return base + np.floor((rank - start) * slope).astype(np.int64)

    def predicted(self, ranks: np.ndarray) -> np.ndarray:
        at = np.searchsorted(self.starts, ranks, "right") - 1
        return self._line(ranks, self.starts[at], self.bases[at], self.slopes[at])

    def offsets(self, ranks: np.ndarray) -> np.ndarray:
        """The exact offsets of boundaries."""
        return self.predicted(ranks) + self.residuals[ranks]


def boundaries(texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Boundaries of all texts as offsets into them all joined, the rank of each text's first one, and each text's start.

    A token is a run of letters A-Z or a-z, or any other code point; a text of n tokens has n + 1 boundaries."""
    points = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = ((points | 32) >= 97) & ((points | 32) <= 122)
    ends = np.cumsum([len(t) for t in texts], dtype=np.int64)
    starts = ends - [len(t) for t in texts]
    begins = np.ones(len(points), bool)
    begins[1:] = ~(letter[1:] & letter[:-1])
    begins[starts[starts < ends]] = True
    places = np.flatnonzero(begins)
    upto = np.searchsorted(places, ends)
    offsets = np.insert(places, upto, ends)
    firsts = np.searchsorted(places, starts) + np.arange(len(texts))
    return offsets, firsts, starts


@dataclasses.dataclass(frozen=True)
class Format:
    """How texts are rearranged. A text that holds a marker stays plain, so the pieces of an output can be told apart."""

    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"
    seed: str = "1:"
    plain_percent: int = 10
    spm_percent: int = 20

    def __post_init__(self):
        pairs = itertools.permutations(self.marks, 2)
        if any(not m or m[0] in m[1:] for m in self.marks) or any(a[0] in b[1:] or b.startswith(a) for a, b in pairs):
            raise ValueError("markers must not begin with each other, and their first characters must not occur later in one")

    @property
    def marks(self) -> tuple[str, str, str]:
        return self.prefix, self.suffix, self.middle

    def draws(self, id: int | None) -> list[int]:
        digest = hashlib.sha256(f"{self.seed}{'' if id is None else id}".encode()).digest()
        return [int.from_bytes(digest[i : i + 4]) for i in range(0, 16, 4)]


SCHEMA = "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string"


def middle_filled(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", format: Format = Format()) -> DataFrame:
    """One row for each input row: doc_id, n (tokens), form (plain, psm or spm), prefix_chars and middle_chars (code points;
    null if plain) and output.

    The first two draws from the SHA-256 of the seed and the id, modulo n + 1, are the cuts, the third says whether the text
    stays plain, the fourth whether the suffix goes first. Empty and null texts, and texts that hold a marker, are plain.
    Rows that share an id share their draws; a null id draws like an empty one. Texts are whole whatever their length.
    """

    def make() -> Callable:
        def part(ids: list, texts: list) -> list[tuple]:
            texts = [t.decode("utf-8", "replace") for t in texts]
            offsets, firsts, starts = boundaries(texts)
            index = RankIndex(offsets, firsts)
            counts = np.append(firsts[1:], len(offsets)) - firsts
            draws = np.array([format.draws(id) for id in ids], np.int64).reshape(-1, 4)
            cuts = np.sort(draws[:, :2] % counts[:, None], axis=1)
            found = index.offsets((cuts + firsts[:, None]).ravel()).reshape(-1, 2) - starts[:, None]
            return [
                rearranged(id, text, n, a, b, draw) for id, text, n, (a, b), draw
                in zip(ids, texts, (counts - 1).tolist(), found.tolist(), draws.tolist())
            ]

        return part

    def rearranged(id: int | None, text: str, n: int, a: int, b: int, draw: list[int]) -> tuple:
        if not text or any(m in text for m in format.marks) or draw[2] % 100 >= 100 - format.plain_percent:
            return id, n, "plain", None, None, text
        first, middle, last = format.prefix + text[:a], format.middle + text[a:b], format.suffix + text[b:]
        if draw[3] % 100 < format.spm_percent:
            return id, n, "spm", a, b - a, last + first + middle
        return id, n, "psm", a, b - a, first + last + middle

    rows = text_bytes(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    return map_parts(rows, make, SCHEMA)


def restored(output: Column | str, form: Column | str, format: Format = Format()) -> Column:
    """The text an output was made from."""
    output, form = (F.col(c) if isinstance(c, str) else c for c in (output, form))

    def between(after: str, before: str | None) -> Column:
        rest = F.substring(output, F.instr(output, F.lit(after)) + len(after), F.length(output))
        return rest if before is None else F.substring(rest, F.lit(1), F.instr(rest, F.lit(before)) - 1)

    prefix = F.when(form == "psm", between(format.prefix, format.suffix)).otherwise(between(format.prefix, format.middle))
    suffix = F.when(form == "psm", between(format.suffix, format.middle)).otherwise(between(format.suffix, format.prefix))
    return F.when(form == "plain", output).otherwise(F.concat(prefix, between(format.middle, None), suffix))
