"""Quality rules from repetition inside a text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from millrace.llm.tables import map_rows, parts, text_bytes
from millrace.llm.words import SPACES, WORD_BYTES, Hasher, byte_table, spans

SYMBOLS = b"#*$%&|<>"
LENGTHS = (5, 6, 7, 8, 9, 10)
# Largest shares of characters in n-grams and lines that repeat earlier ones. A tenth above published limits for web
# text, so that a short text whose head line comes back at its end stays.
MOST_IN_GRAMS = {n: 0.30 - 0.01 * n for n in LENGTHS}
MOST_IN_LINES = 0.30
MOST_SYMBOLS = 0.2  # symbols a word
FEWEST_WORDS = 20
MOST_REPEATED = 30  # percent of words in repeated windows
WINDOW = 8

LEADS = byte_table(bytes(range(0x80, 0xC0)), inverted=True)  # bytes that begin a code point
WORD_LEADS = LEADS * WORD_BYTES
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, "
    "line_share double, gram_shares array<double>, base_failed boolean, kept boolean"
)


def repeats(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks of the values that occur twice or more, and of those that have an equal one before them."""
    order = np.argsort(hashes, kind="stable")
    ranked = hashes[order]
    same = ranked[1:] == ranked[:-1]
    any_, later = np.zeros(len(hashes), bool), np.zeros(len(hashes), bool)
    later[order[1:]] = same
    any_[order[1:]] = same
    any_[order[:-1]] |= same
    return any_, later


def covered(marks: np.ndarray, n: int, words: int) -> np.ndarray:
    """The words that lie in a marked run of n words."""
    edge = np.zeros(words + 1, np.int64)
    at = np.flatnonzero(marks)
    np.add.at(edge, at, 1)
    np.add.at(edge, at + n, -1)
    return np.cumsum(edge[:-1]) > 0


class Rules:
    """Measures and verdict of one text; holds the tables of the hashes."""

    def __init__(self):
        self.hasher = Hasher()

    def lines(self, text: bytes) -> tuple[int, int]:
        """Lines with a word that equal an earlier one, and their characters outside white space."""
        seen, count, chars = set(), 0, 0
        for line in text.split(b"\n"):
            if line in seen:
                count += 1
                chars += int(WORD_LEADS[np.frombuffer(line, np.uint8)].sum(dtype=np.int64))
            elif line.strip(SPACES):
                seen.add(line)
        return count, chars

    def measure(self, text: bytes) -> tuple:
        data = np.frombuffer(text, np.uint8)
        counts = np.bincount(data, minlength=256)
        word_chars = int(counts @ WORD_LEADS)
        symbols = int(counts[list(SYMBOLS)].sum())
        starts, ends = spans(data)
        total = len(starts)
        dup_lines, line_chars = self.lines(text)
        words = self.hasher.words(data, starts, ends)
        repeat_words, shares = 0, [0.0] * len(LENGTHS)
        if total:
            leads = np.concatenate([[0], np.cumsum(LEADS[data], dtype=np.int64)])
            chars = leads[ends] - leads[starts]
            for i, n in enumerate(LENGTHS):
                twice, later = repeats(self.hasher.grams(words, n))
                if not later.any():
                    break  # a longer run repeats only where a shorter one does
                shares[i] = float(chars[covered(later, n, total)].sum()) / word_chars
                if n == WINDOW:
                    repeat_words = int(covered(twice, n, total).sum())
        line_share = line_chars / word_chars if word_chars else 0.0
        failed = total < FEWEST_WORDS or 100 * repeat_words > MOST_REPEATED * total
        good = (
            not failed and line_share <= MOST_IN_LINES and symbols <= MOST_SYMBOLS * total
            and all(share <= MOST_IN_GRAMS[n] for n, share in zip(LENGTHS, shares))
        )
        return total, word_chars, symbols, dup_lines, repeat_words, line_share, shares, failed, good


def repetition_rules(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each input row: counts, the shares of characters in repeated lines and n-grams, and the verdict.

    Words are runs without ASCII white space. ``n_repeat_words`` counts the words in 8-word windows found twice or more,
    the first one included; the shares count what repeats something before it. A null text is an empty one; it has fewer
    than 20 words and is not kept. Null ids and repeated rows are measured like any other. Rolling hashes make the cost
    linear in the text but for a sort of its windows.
    """

    def make() -> Callable:
        rules = Rules()
        return lambda id, text: (id, *rules.measure(text))

    return map_rows(text_bytes(docs, id_col, text_col), make, SCHEMA)


def good_documents(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows whose text passes the rules, with all their columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rules = Rules()
        for batch in parts(batches):
            texts = batch.column(batch.schema.get_field_index(text_col)).to_pylist()
            yield batch.filter(pa.array([rules.measure((t or "").encode())[-1] for t in texts], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
