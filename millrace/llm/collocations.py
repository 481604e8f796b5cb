"""Phrase collocations: frequent pairs and triples of words by direct-address tiling.

Texts become chunks of word codes with a dictionary each. Frequent words are numbered by frequency, so that the pairs that
occur most lie in a few square tiles of the table of all pairs: those are counted by ``bincount`` into dense tiles, all others
as sorted lists of cells with counts. Frequent pairs are numbered by frequency in turn, and pairs of overlapping pairs, which
are triples of words, are counted in the same way. A phrase can only be frequent if its parts are, so nothing is lost.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tables import Scratch, slices
from millrace.llm.words import byte_table, spans
from millrace.operators.ordering import ordered_index
from millrace.session import write_and_read

BREAKS = b".,;:!?\x0a\x0b\x0c\x0d"
IS_BREAK = byte_table(BREAKS)
IS_WORD = byte_table(BREAKS + b" \t", inverted=True)
CUT = re.compile(b"[" + re.escape(BREAKS) + b"]")
CHUNK = 1 << 19  # bytes of text in a chunk
HELD = 16 * CHUNK  # bytes a task holds back for chunks of several languages
SIDE = 512  # words along a tile
GATHERED = 1 << 19  # pairs counted at a time
DENSE = SIDE * SIDE // 8  # of these, pairs that make a tile dense
TILES = 8  # dense tiles a task holds
LISTED = 1 << 20  # cells of sparse tiles a task holds
MOST_ROWS, MOST_BYTES = 3 << 19, 32 << 20  # numbered units that may go to the tasks; beyond, they are joined


def chunks(docs: DataFrame, text_col: str, lang_col: str) -> DataFrame:
    """Rows (chunk, lang, words, counts, codes): the distinct words of a stretch of texts of one language with their counts,
    and the texts as places in that list, 32 bits each, -1 between pieces."""

    def encoded(lang: str, texts: list[bytes], number: int) -> dict:
        data = np.frombuffer(b"\n".join(texts).lower(), np.uint8)
        starts, ends = spans(data, IS_WORD)
        sizes = ends - starts
        offsets = np.zeros(len(starts) + 1, np.int64)
        np.cumsum(sizes, out=offsets[1:])
        letters = data[IS_WORD[data].astype(bool)]
        words = pa.LargeBinaryArray.from_buffers(
            pa.large_binary(), len(starts), [None, pa.py_buffer(offsets), pa.py_buffer(letters)]).dictionary_encode()
        code = np.asarray(words.indices, np.int32)
        counts = np.bincount(code, minlength=len(words.dictionary))
        parted = np.cumsum(IS_BREAK[data], dtype=np.int32)[starts]
        codes = np.insert(code, np.flatnonzero(np.diff(parted)) + 1, -1).astype(np.int32)
        return {"chunk": number, "lang": lang, "words": words.dictionary, "counts": counts, "codes": codes.tobytes()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list[bytes]] = {}
        sizes: dict[str, int] = {}
        number = TaskContext.get().partitionId() << 32

        def flushed(lang: str) -> pa.RecordBatch:
            nonlocal number
            sizes.pop(lang)
            row = encoded(lang, held.pop(lang), number)
            number += 1
            return pa.RecordBatch.from_arrays([
                pa.array([row["chunk"]], pa.int64()), pa.array([lang], pa.string()),
                pa.ListArray.from_arrays(pa.array([0, len(row["words"])], pa.int32()), row["words"].cast(pa.string())),
                pa.ListArray.from_arrays(pa.array([0, len(row["counts"])], pa.int32()), pa.array(row["counts"], pa.int64())),
                pa.array([row["codes"]], pa.binary()),
            ], names=["chunk", "lang", "words", "counts", "codes"])

        for batch in batches:
            for part in slices(batch):
                for text, lang in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for piece in pieces(text):
                        held.setdefault(lang, []).append(piece)
                        sizes[lang] = sizes.get(lang, 0) + len(piece) + 1
                        if sizes[lang] >= CHUNK:
                            yield flushed(lang)
                    while sum(sizes.values()) >= HELD:
                        yield flushed(max(sizes, key=sizes.get))
        for lang in list(held):
            yield flushed(lang)
        pa.default_memory_pool().release_unused()  # the worker goes on to other stages

    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).cast("binary")
    lang = F.coalesce(F.col(f"`{lang_col}`").cast("string"), F.lit("und"))
    return docs.select(text.alias("text"), lang.alias("lang")).mapInArrow(
        run, "chunk long, lang string, words array<string>, counts array<long>, codes binary")


def pieces(text: bytes) -> Iterator[bytes]:
    """A text in parts of about a chunk's size, cut where phrases end."""
    at = 0
    while len(text) - at > CHUNK:
        cut = CUT.search(text, at + CHUNK)
        if not cut:
            break
        yield text[at : cut.start()]
        at = cut.end()
    yield text[at:]


class PairCounts:
    """Counts of pairs of numbers below ``size``, the smallest the most frequent; what it holds is bounded, and what it
    drains may repeat a pair."""

    def __init__(self, size: int, side: int = SIDE, dense: int = DENSE, tiles: int = TILES, listed: int = LISTED):
        if size * size >= 2**63:
            raise ValueError("more units than pairs of them have 64-bit numbers")
        self.size, self.side, self.dense, self.most, self.listed = size, side, dense, tiles, listed
        self.tiles: dict[int, np.ndarray] = {}
        self.cells, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def add(self, first: np.ndarray, second: np.ndarray) -> None:
        across = -(-self.size // self.side)
        tile = first // self.side * across + second // self.side
        kinds, at, held = np.unique(tile, return_inverse=True, return_counts=True)
        rest = np.ones(len(tile), bool)
        for i in np.flatnonzero(held >= self.dense):
            mine = at == i
            rest &= ~mine
            cell = first[mine] % self.side * self.side + second[mine] % self.side
            if int(kinds[i]) not in self.tiles:
                self.tiles[int(kinds[i])] = np.zeros(self.side * self.side, np.int64)
            self.tiles[int(kinds[i])] += np.bincount(cell, minlength=self.side * self.side)
        cells, counts = np.unique(first[rest] * self.size + second[rest], return_counts=True)
        if not len(self.cells):
            self.cells, self.counts = cells, counts
        else:
            self.cells, at = np.unique(np.concatenate([self.cells, cells]), return_inverse=True)
            self.counts = np.bincount(at, np.concatenate([self.counts, counts])).astype(np.int64)

    @property
    def full(self) -> bool:
        return len(self.tiles) > self.most or len(self.cells) > self.listed

    def drain(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Cells (first times size plus second) and counts of all pairs held, which are then forgotten; tile by tile, since
        the cells of a tile as a list take several times its room."""
        yield self.cells, self.counts
        self.cells, self.counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        across = -(-self.size // self.side)
        while self.tiles:
            tile, dense = self.tiles.popitem()
            cell = np.flatnonzero(dense)
            first, second = tile // across * self.side + cell // self.side, tile % across * self.side + cell % self.side
            yield first * self.size + second, dense[cell]


def adjacent(ids: np.ndarray) -> np.ndarray:
    """The places of units that another one follows."""
    return np.flatnonzero((ids[:-1] >= 0) & (ids[1:] >= 0))


Numbers = Callable[[pa.RecordBatch], Iterator[np.ndarray]]


def counted(level: DataFrame, ids: Numbers, size: int) -> DataFrame:
    """(cell, n) of adjacent units in the chunks; a cell may have several rows for each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = PairCounts(size)
        first, second = [], []

        def add() -> None:
            counts.add(np.concatenate(first), np.concatenate(second))
            first.clear()
            second.clear()

        def drained() -> Iterator[pa.RecordBatch]:
            for part in counts.drain():
                yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in part], names=["cell", "n"])

        for batch in batches:
            for numbers in ids(batch):
                at = adjacent(numbers)
                first.append(numbers[at])
                second.append(numbers[at + 1])
                if sum(map(len, first)) >= GATHERED:
                    add()
                    if counts.full:
                        yield from drained()
        if first:
            add()
        yield from drained()

    return level.mapInArrow(run, "cell long, n long")


def frequent_pairs(level: DataFrame, ids: Numbers, size: int, least: int) -> DataFrame:
    """(first, second, n) of the pairs of adjacent units that occur ``least`` times or more.

    The tasks have summed up already what they could, so the rows are dealt out before they are summed again."""
    found = counted(level, ids, size).repartition("cell").groupBy("cell").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    wide = F.lit(max(size, 1)).cast("long")
    first = F.call_function("div", F.col("cell"), wide).alias("first")
    return found.select(first, (F.col("cell") % wide).alias("second"), "n")


def numbered(units: DataFrame, order: list[str], scratch: Scratch) -> DataFrame:
    """Units with a column id, 0 for the most frequent."""
    return scratch.save(ordered_index(units, [F.desc("n"), *order], "id"))


def looked_up(level: DataFrame, own: DataFrame, units: DataFrame, keys: list[str]) -> DataFrame:
    """The chunks of a level with a column ids: the numbers of their own units (chunk, place, keys), -1 for others.

    The units of a chunk are as many as its dictionary has, so its list is bounded by the size of a chunk."""
    found = own.join(units.select(*keys, "id"), keys).groupBy("chunk").agg(F.collect_list(F.struct("place", "id")).alias("ids"))
    return level.join(found, "chunk", "left").select("chunk", "codes", F.col("ids.place").alias("places"), F.col("ids.id").alias("ids"))


def column(batch: pa.RecordBatch, name: str) -> pa.Array:
    return batch.column(batch.schema.get_field_index(name))


def from_lists(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
    """The numbers of chunks made by ``looked_up``."""
    for codes, places, ids in zip(column(batch, "codes"), column(batch, "places"), column(batch, "ids")):
        codes = np.frombuffer(codes.as_py(), np.int32)
        table = np.full(int(codes.max(initial=-1)) + 2, -1, np.int64)
        if places.is_valid:
            table[np.asarray(places.values, np.int64)] = np.asarray(ids.values, np.int64)
        yield table[codes]  # code -1 takes the last place, which no unit has


def collocations(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", least: int = 10, inside_percent: int = 50, top: int = 2000,
    most_rows: int = MOST_ROWS, most_bytes: int = MOST_BYTES,
) -> DataFrame:
    """The ``top`` phrases of two or three words of each language: lang, rank (from 1), phrase, a, l, r, n, score.

    A-Z are lower-cased; texts are cut at ``.,;:!?`` and line ends into pieces, and those at blanks and tabs into words. For a
    phrase found ``least`` times or more (a), the cut with the lowest score floor(1000000 a a / (l r)) counts, where l and r are
    the counts of the parts; the first cut of equal ones. n is the number of words of the language. Two-word phrases inside a
    three-word one with at least ``inside_percent`` of their count go. Order: score, then a, both falling, then the phrase by
    bytes. Null texts are empty; null languages are ``und``; repeated rows count again; no rows give none. Other columns are not
    read. Long texts are cut into chunks where phrases end.

    Numbered words or pairs go to the tasks while they are at most ``most_rows`` and ``most_bytes``; beyond, chunks get theirs by
    joins, with the same result.
    """
    spark = docs.sparkSession
    with Scratch(spark) as scratch:
        level = scratch.save(chunks(docs, text_col, lang_col))
        listed = level.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("u")).select(
            "lang", F.col("u.words").alias("word"), F.col("u.counts").alias("n"))
        words = scratch.save(listed.groupBy("lang", "word").agg(F.sum("n").alias("n")))
        totals = scratch.save(words.groupBy("lang").agg(F.sum("n").alias("total")))
        words = numbered(words.where(F.col("n") >= least), ["lang", "word"], scratch)
        count, size = words.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("word") + F.octet_length("lang")), F.lit(0))).first()
        if count <= most_rows and size <= most_bytes:
            coded, word_ids = level.select("lang", "words", "codes"), word_finder(words.select("lang", "word", "id").toArrow())
        else:
            own = level.select("chunk", "lang", F.posexplode("words").alias("place", "word"))
            coded, word_ids = scratch.save(looked_up(level, own, words, ["lang", "word"])), from_lists

        pairs = numbered(frequent_pairs(coded, word_ids, count, least), ["first", "second"], scratch)
        kinds = pairs.count()
        if kinds <= most_rows:
            triples = frequent_pairs(coded, pair_finder(word_ids, pairs.select("first", "second", "id").toArrow(), count), kinds, least)
        else:
            paired = scratch.save(pair_chunks(coded, word_ids, count))
            own = paired.select("chunk", F.posexplode(F.arrays_zip("first", "second")).alias("place", "u")).select(
                "chunk", "place", "u.first", "u.second")
            triples = frequent_pairs(scratch.save(looked_up(paired, own, pairs, ["first", "second"])), from_lists, kinds, least)
        triples = scratch.save(triples.withColumnsRenamed({"first": "pair", "second": "next"}))
        return write_and_read(ranked(words, pairs, triples, totals, inside_percent, top, scratch))


def word_finder(table: pa.Table) -> Numbers:
    """Numbers of the words of chunks from a table of all numbered ones."""
    langs = {}
    for lang in pc.unique(table["lang"]).to_pylist():
        mine = table.filter(pc.equal(table["lang"], lang))
        langs[lang] = mine["word"].combine_chunks(), np.asarray(mine["id"], np.int64)

    def ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        rows: dict[str, list[int]] = {}
        for row, lang in enumerate(column(batch, "lang").to_pylist()):
            rows.setdefault(lang, []).append(row)
        words, codes = column(batch, "words"), column(batch, "codes")
        for lang, mine in rows.items():
            listed = [words[row].values for row in mine]
            numbers = np.full(sum(map(len, listed)), -1, np.int64)
            if lang in langs:  # all chunks of a language at once: each look-up makes a table of the known words
                known, known_ids = langs[lang]
                place = pc.index_in(pa.concat_arrays(listed), value_set=known.cast(listed[0].type))
                numbers = np.append(known_ids, -1)[np.asarray(pc.fill_null(place, -1), np.int64)]
            ends = np.cumsum([len(x) for x in listed])
            for row, low, high in zip(mine, ends - [len(x) for x in listed], ends):
                yield np.append(numbers[low:high], -1)[np.frombuffer(codes[row].as_py(), np.int32)]

    return ids


def pair_finder(word_ids: Numbers, table: pa.Table, size: int) -> Numbers:
    """Numbers of the frequent pairs that begin at each place of chunks."""
    cells = np.asarray(table["first"], np.int64) * size + np.asarray(table["second"], np.int64)
    order = np.argsort(cells)
    cells, numbers = cells[order], np.asarray(table["id"], np.int64)[order]

    def ids(batch: pa.RecordBatch) -> Iterator[np.ndarray]:
        for words in word_ids(batch):
            at = adjacent(words)
            out = np.full(len(words), -1, np.int64)
            if len(cells):
                mine = words[at] * size + words[at + 1]
                place = np.minimum(np.searchsorted(cells, mine), len(cells) - 1)
                out[at] = np.where(cells[place] == mine, numbers[place], -1)
            yield out

    return ids


def pair_chunks(level: DataFrame, ids: Numbers, size: int) -> DataFrame:
    """The chunks as places in a list of their distinct pairs of adjacent units, one that begins at each unit."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            for numbers in ids(batch):
                at = adjacent(numbers)
                cells, place = np.unique(numbers[at] * size + numbers[at + 1], return_inverse=True)
                codes = np.full(len(numbers), -1, np.int32)
                codes[at] = place
                ends = pa.array([0, len(cells)], pa.int32())
                yield pa.RecordBatch.from_arrays([
                    pa.array([number], pa.int64()),
                    pa.ListArray.from_arrays(ends, pa.array(cells // max(size, 1), pa.int64())),
                    pa.ListArray.from_arrays(ends, pa.array(cells % max(size, 1), pa.int64())),
                    pa.array([codes.tobytes()], pa.binary()),
                ], names=["chunk", "first", "second", "codes"])
                number += 1

    return level.mapInArrow(run, "chunk long, first array<long>, second array<long>, codes binary")


def ratio(a: Column, l: Column, r: Column) -> Column:  # noqa: E741
    """floor(1000000 a a / (l r)) in whole numbers of up to 38 digits."""
    wide = [x.cast("decimal(38,0)") for x in (a, l, r)]
    return F.call_function("div", F.lit(1_000_000).cast("decimal(38,0)") * wide[0] * wide[0], wide[1] * wide[2]).cast("long")


def ranked(
    words: DataFrame, pairs: DataFrame, triples: DataFrame, totals: DataFrame, inside_percent: int, top: int, scratch: Scratch
) -> DataFrame:
    a, b = words.select(F.col("id").alias("first"), "lang", F.col("word").alias("x"), F.col("n").alias("nx")), words.select(
        F.col("id").alias("second"), F.col("word").alias("y"), F.col("n").alias("ny"))
    known = scratch.save(pairs.withColumnsRenamed({"id": "pair", "n": "a"}).join(a, "first").join(b, "second").select(
        "pair", "lang", "x", "y", "nx", "ny", "a"))
    inside = triples.select(F.explode(F.array("pair", "next")).alias("pair"), "n").groupBy("pair").agg(F.max("n").alias("longer"))
    two = known.join(inside, "pair", "left").where(F.coalesce(100 * F.col("longer") < inside_percent * F.col("a"), F.lit(True)))
    two = two.select("lang", F.concat_ws(" ", "x", "y").alias("phrase"), "a", F.col("nx").alias("l"), F.col("ny").alias("r"),
                     ratio(F.col("a"), F.col("nx"), F.col("ny")).alias("score"))
    front = known.select("pair", "lang", "x", "y", F.col("nx").alias("l1"), F.col("a").alias("l2"))
    back = known.select(F.col("pair").alias("next"), F.col("y").alias("z"), F.col("a").alias("r1"), F.col("ny").alias("r2"))
    cut = [F.struct(ratio(F.col("n"), F.col(f"l{k}"), F.col(f"r{k}")).alias("score"), F.lit(k).alias("k"), F.col(f"l{k}").alias("l"),
                    F.col(f"r{k}").alias("r")) for k in (1, 2)]
    three = triples.join(front, "pair").join(back, "next").withColumn("cut", F.least(*cut)).select(
        "lang", F.concat_ws(" ", "x", "y", "z").alias("phrase"), F.col("n").alias("a"), "cut.l", "cut.r", "cut.score")
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    best = scratch.save(two.union(three)).withColumn("rank", place.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", F.col("total").alias("n"), "score")
