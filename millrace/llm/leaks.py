"""Benchmark decontamination: passages within an edit distance of benchmark items.

The CGK embedding (Chakraborty, Goldenberg, Koucky, 2016) walks over a word sequence: step j puts out the word at the
walk's place and moves on by a random bit that depends on j and the word. Sequences with few edits give embeddings with
a small Hamming distance, since two walks that an edit has parted soon meet again. Bit sampling, the words at a few random
steps, is then a locality-sensitive key. Windows of the documents and items meet in any of several repetitions, and an
exact edit distance decides.

A long item is keyed by segments that cover it: of edits up to a share of the item's words, some segment has no more than
that share of its own words. So walk lengths and window spacings stay small whatever an item's length.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.licenses import WORD_BYTES as WORD_MAP
from millrace.llm.tables import parts, text_bytes
from millrace.llm.words import SPACES, Hasher, byte_table, mix, spans

EDITS = 0.2  # most edits, as a share of an item's words
SAMPLES = 3  # sampled steps in a key
REPEATS = 48  # keys; with them passages with a fifth of their words edited are found with a recall above 0.99 (see the tests)
GROWTH = 1.25  # a class of segments holds lengths up to this factor
SEGMENT = 16  # most words of a segment
BLOCK = 5_000  # items at a time
WORDS = byte_table(bytes(c for c in range(256) if WORD_MAP[c] not in SPACES))
BITS = 18
STEPS = 64  # most steps of a walk, one bit of a hash each
CHUNK = 1 << 20  # words of documents at a time


def tokens(text: bytes, hasher: Hasher) -> np.ndarray:
    """Hashes of the words: runs of letters, digits and characters beyond ASCII, A-Z in lower case."""
    data = np.frombuffer(text.lower(), np.uint8)
    return hasher.words(data, *spans(data, WORDS))


def best_match(item: np.ndarray, region: np.ndarray) -> tuple[int, int, int]:
    """(edits, start, end) of the part of the region nearest to the item; the first end and the latest start of equal ones.

    The usual table row by row: gaps along a row are a running minimum."""
    width = len(region)
    along = np.arange(width + 1)
    cost = np.zeros(width + 1, np.int64)
    start = along.copy()
    for i, word in enumerate(item, 1):
        diagonal = cost[:-1] + (region != word)
        down = cost[1:] + 1
        low = np.concatenate([[i], np.minimum(diagonal, down)])
        begin = np.concatenate([[0], np.where(diagonal <= down, start[:-1], start[1:])])
        # a gap of g words costs g: the place with the smallest cost minus position, the last one of equal places
        key = (low - along) * (width + 1) - along
        from_ = -np.minimum.accumulate(key) % (width + 1)
        cost = low[from_] + along - from_
        start = begin[from_]
    end = int(np.argmin(cost))
    return int(cost[end]), int(start[end]), end


class Items:
    """A block of benchmark items with the tables to find them in documents."""

    def __init__(self, texts: Sequence[str | None], repeats: int = REPEATS, edits: float = EDITS):
        hasher = Hasher()
        self.edits = edits
        self.words = [tokens((t or "").encode(), hasher) for t in texts]
        pairs = [neighbours(w) for w in self.words]
        self.pairs = np.unique(np.concatenate(pairs or [np.empty(0, np.uint64)]))
        self.quick = np.zeros(1 << BITS, bool)
        self.quick[self.pairs >> np.uint64(64 - BITS)] = True
        self.classes = []
        left = sorted(
            ((i, a, b) for i, w in enumerate(self.words) for a, b in segments(len(w))), key=lambda x: (x[2] - x[1], *x))
        while left:
            longest = (left[0][2] - left[0][1]) * GROWTH
            alike = [x for x in left if x[2] - x[1] <= longest]
            left = left[len(alike):]
            self.classes.append(self._class(alike))
        flat, ends = padded(self.words)
        begin = ends - [len(w) for w in self.words] if len(self.words) else ends
        seeds = mix(np.arange(1, repeats + 1, dtype=np.uint64) * np.uint64(0xA24BAED4963EE407))
        self.tables = [(seed, self._tables(number, seed, flat, begin)) for number, seed in enumerate(seeds)]

    def most(self, i: int) -> int:
        return int(self.edits * len(self.words[i]) + 1e-9)

    def _class(self, members: list[tuple[int, int, int]]) -> dict:
        """Segments of like length: window spacing, walk length, filter width and the fewest neighbours a match keeps: an
        edit parts at most two pairs of neighbouring words."""
        sizes = [b - a for _, a, b in members]
        most = [int(self.edits * n + 1e-9) for n in sizes]
        fewest = min(n - 1 - 2 * e for n, e in zip(sizes, most))
        stride, steps = max(1, min(sizes) // 8), min(STEPS, 2 * min(sizes))
        width = max(sizes) + max(most) + stride
        return {"members": [(i, a) for i, a, _ in members], "stride": stride, "steps": steps, "width": width, "fewest": fewest}

    def _tables(self, number: int, seed: np.uint64, flat: np.ndarray, begin: np.ndarray) -> list[tuple]:
        """For each class the sampled steps, the keys after each, and the segments (item, first word) of the last keys."""
        out = []
        for c in self.classes:
            draw = np.random.default_rng((number, c["steps"]))
            count = min(SAMPLES, c["steps"])
            cuts = [c["steps"] * i // count for i in range(count + 1)]
            at = [int(draw.integers(x, y)) for x, y in zip(cuts, cuts[1:])]
            _, seen = walk(flat, seed, np.array([begin[i] + a for i, a in c["members"]]), at)
            keys: dict[int, list[tuple[int, int]]] = {}
            for member_, key in zip(c["members"], seen[-1].tolist()):
                keys.setdefault(key, []).append(member_)
            out.append((at, [np.unique(s) for s in seen], keys))
        return out

    def find(self, texts: Sequence[np.ndarray]) -> list[list[tuple[int, int, int, int]]]:
        """For each text (item, edits, first word, number of words) of the best match of every item found."""
        found: list[dict] = [{} for _ in texts]
        words, ends = padded(texts)
        n = len(words) - STEPS
        after = neighbours(words)
        maybe = np.flatnonzero(self.quick[after >> np.uint64(64 - BITS)])
        known = np.zeros(len(words) + 1, np.int32)
        known[maybe + 1] = member(after[maybe], self.pairs)
        known = np.cumsum(known)
        windows = []
        for c in self.classes:
            starts = np.arange(0, n, c["stride"])
            # windows begin up to one spacing before a match, so none that could match is left out
            windows.append(starts[known[np.minimum(starts + c["width"], len(words))] - known[starts] >= c["fewest"]])
        tried: dict[tuple[int, int], list[int]] = {}
        for seed, tables in self.tables:
            for c, starts, (at, prefixes, keys) in zip(self.classes, windows, tables):
                left, seen = walk(words, seed, starts, at, prefixes)
                for start, key in zip(left.tolist(), seen[-1].tolist()):
                    text = int(np.searchsorted(ends, start, "right"))
                    first = start - int(ends[text] - len(texts[text])) if text < len(texts) else 0
                    for item, offset in keys[key] if text < len(texts) else ():
                        place = first - offset
                        before = tried.setdefault((text, item), [])
                        if all(abs(place - b) > self.most(item) for b in before):
                            before.append(place)
                            self._verify(texts[text], item, place, c["stride"], found[text])
        return [sorted((item, *match) for item, match in f.items()) for f in found]

    def _verify(self, words: np.ndarray, item: int, start: int, stride: int, found: dict) -> None:
        if item in found and not found[item][0]:
            return
        size, most = len(self.words[item]), self.most(item)
        # the place is where the item would begin without edits before the segment; one up to ``most`` away stands for it
        low = max(0, start - 3 * most - 2 * stride)
        region = words[low : max(low, start + size + 4 * most + 2 * stride)]
        if member(neighbours(self.words[item]), np.sort(neighbours(region))).sum() < size - 1 - 2 * most:
            return
        edits, a, b = best_match(self.words[item], region)
        if edits <= most and (item not in found or edits < found[item][0]):
            found[item] = (edits, low + a, b - a)


def segments(size: int) -> list[tuple[int, int]]:
    """Starts and ends of the parts of nearly equal length, at most ``SEGMENT``, that cover so many words."""
    count = -(-size // SEGMENT)
    return [(size * i // count, size * (i + 1) // count) for i in range(count)]


def neighbours(words: np.ndarray) -> np.ndarray:
    """Hashes of the pairs of neighbouring words."""
    return mix(words[:-1] + words[1:] * np.uint64(0xD6E8FEB86659FD93))


def padded(texts: Sequence[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """All words in a row, ``STEPS`` empty words before, between and after the texts; and where each text ends."""
    gap = np.zeros(STEPS, np.uint64)
    parts = [gap]
    for t in texts:
        parts += [t, gap]
    sizes = np.array([len(t) + STEPS for t in texts], np.int64)
    return np.concatenate(parts), np.cumsum(sizes)


def member(values: np.ndarray, ranked: np.ndarray) -> np.ndarray:
    if not len(ranked):
        return np.zeros(len(values), bool)
    return ranked[np.minimum(np.searchsorted(ranked, values), len(ranked) - 1)] == values


def walk(
    words: np.ndarray, seed: np.uint64, starts: np.ndarray, at: Sequence[int], prefixes: Sequence[np.ndarray] | None = None
) -> tuple[np.ndarray, list[np.ndarray]]:
    """CGK walks from all starts, and the key after each sampled step. Bit j of a word's seeded hash says whether step j
    moves on. With ``prefixes``, only walks whose key is among those of that level go on."""
    place = starts
    key = np.zeros(len(starts), np.uint64)
    seen, step = [], 0
    for level, sampled in enumerate(at):
        while step < sampled:
            place = place + ((mix(words[place] + seed) >> np.uint64(step)) & np.uint64(1)).astype(np.int64)
            step += 1
        key = mix(key + words[place] + np.uint64(sampled + 1))
        if prefixes is not None:
            going = np.flatnonzero(member(key, prefixes[level]))
            starts, place, key = starts[going], place[going], key[going]
        seen.append(key)
    return starts, seen


def item_blocks(benchmark: DataFrame, id_col: str, text_col: str, block: int) -> Iterator[tuple[list, Items]]:
    """The benchmark in blocks of about ``block`` items, dealt by a hash of the text: ids and tables of each."""
    rows = benchmark.select(F.col(f"`{id_col}`").cast("long").alias("id"), F.col(f"`{text_col}`").cast("string").alias("text"))
    count = math.ceil(rows.count() / block)
    for number in range(count):
        part = rows.where(F.pmod(F.xxhash64("text"), F.lit(count)) == number).collect()
        part.sort(key=lambda r: (r.text or "", r.id is None, r.id or 0))
        yield [r.id for r in part], Items([r.text for r in part])


SCHEMA = "doc_id long, item_id long, edits long, first_word long, n_words long"


def leaked_passages(
    docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id",
    item_text_col: str = "text", block: int = BLOCK,
) -> DataFrame:
    """One row for each document row and benchmark item of which the document holds a passage with at most a fifth as many
    word edits as the item has words: doc_id, item_id, edits, first_word, n_words (of the best passage).

    Words are runs of letters, digits and characters beyond ASCII; A-Z are lower-cased, so case and punctuation do not
    count. Items without words match nothing; those under five words only exactly. Null texts hold nothing; null ids and
    repeated rows of either table are reported like any other. Documents go through in one pass for each block of items;
    a block's tables go to the tasks. Windows with fewer of the items' pairs of neighbouring words than edits can leave are
    passed over, which loses no match; the keys find a passage with a recall above 0.99, and every reported one is exact.
    """
    texts = text_bytes(docs, id_col, text_col).withColumn("id", F.col("id").cast("long"))
    out = docs.sparkSession.createDataFrame([], SCHEMA)
    for ids, items in item_blocks(benchmark, item_col, item_text_col, block):
        out = out.union(texts.mapInArrow(_finder(ids, items), SCHEMA))
    return out


def _chunks(texts: Sequence[bytes], hasher: Hasher) -> Iterator[list[np.ndarray]]:
    """The texts' words in lists of about ``CHUNK`` words."""
    chunk, size = [], 0
    for text in texts:
        chunk.append(tokens(text, hasher))
        size += len(chunk[-1])
        if size >= CHUNK:
            yield chunk
            chunk, size = [], 0
    if chunk:
        yield chunk


def _finder(ids: list, items: Items) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for batch in parts(batches):
            found = [f for chunk in _chunks(batch.column(1).to_pylist(), hasher) for f in items.find(chunk)]
            rows = [(doc, ids[item], *match) for doc, f in zip(batch.column(0).to_pylist(), found) for item, *match in f]
            columns = list(zip(*rows)) if rows else [()] * 5
            names = [part.split()[0] for part in SCHEMA.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=names)

    return run


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_text_col: str = "text", block: int = BLOCK) -> DataFrame:
    """The rows of documents that hold no passage of any item, with all their columns."""

    def keeping(items: Items) -> Callable:
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            hasher = Hasher()
            for batch in parts(batches):
                texts = [(t or "").encode() for t in batch.column(batch.schema.get_field_index(text_col)).to_pylist()]
                clean = [not f for chunk in _chunks(texts, hasher) for f in items.find(chunk)]
                yield batch.filter(pa.array(clean, pa.bool_()))

        return run

    named = benchmark.withColumn("_no_id", F.lit(None).cast("long"))
    for _, items in item_blocks(named, "_no_id", item_text_col, block):
        docs = docs.mapInArrow(keeping(items), docs.schema)
    return docs
