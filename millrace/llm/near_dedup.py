"""Near-duplicate groups with SetSketch registers."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.setsketch import banding, bands, registers, similarity
from millrace.llm.stars import components
from millrace.llm.tables import Scratch, map_rows, small, text_bytes
from millrace.llm.words import Hasher, mix
from millrace.session import write_and_read

SLACK = 4.5  # standard deviations of the joint estimate below the threshold that still go to the exact check


def sketches(docs: DataFrame, id_col: str, text_col: str, words: int, rows: int, count: int) -> DataFrame:
    """One row a document: id, n (shingles), f and g (a 128-bit fingerprint of the set), regs (16-bit registers), keys (a
    key for each band)."""

    def make() -> Callable:
        hasher = Hasher()

        def one(id: int | None, text: bytes) -> tuple:
            s = hasher.shingles(text, words)
            if not len(s):
                return id, 0, None, None, None, None
            r = registers(s, rows * count)
            f, g = (int(x.sum().view(np.int64)) for x in (mix(s), mix(s + np.uint64(1))))
            return id, len(s), f, g, r.tobytes(), bands(r, rows).tolist()

        return one

    return map_rows(
        text_bytes(docs, id_col, text_col).withColumn("id", F.col("id").cast("long")), make,
        "id long, n long, f long, g long, regs binary, keys array<long>",
    )


def likely(pairs: DataFrame, sketched: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose joint estimate does not rule out the threshold; adds nothing, keeps the pair columns."""

    def side(name: str) -> DataFrame:
        return sketched.select(F.col("id").alias(name), F.col("n").alias(f"n_{name}"), F.col("regs").alias(f"regs_{name}"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = {name: i for i, name in enumerate(batch.schema.names)}
            regs = [
                np.frombuffer(b"".join(batch.column(at[f"regs_{x}"]).to_pylist()), np.uint16).reshape(batch.num_rows, -1)
                for x in "ab"
            ] if batch.num_rows else [np.zeros((0, 1), np.uint16)] * 2
            sizes = [np.asarray(batch.column(at[f"n_{x}"])).astype(float) for x in "ab"]
            bound = threshold - SLACK * np.sqrt(threshold * (1 - threshold) / max(1, regs[0].shape[1]))
            kept = pa.array(similarity(*regs, *sizes) >= bound) if batch.num_rows else pa.array([], pa.bool_())
            yield batch.select(["a", "b", "comp_a", "comp_b"]).filter(kept)

    return pairs.join(side("b"), "b").join(side("a"), "a").select(
        "a", "b", "comp_a", "comp_b", "n_a", "n_b", "regs_a", "regs_b"
    ).mapInArrow(run, "a long, b long, comp_a long, comp_b long")


def confirmed(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The pairs whose full shingle sets reach the threshold."""
    shared = F.size(F.array_intersect("set_a", "set_b")).cast("long")
    union = F.size("set_a") + F.size("set_b") - shared
    return (
        pairs.join(sets.select(F.col("id").alias("id_b"), F.col("s").alias("set_b")), F.col("b") == F.col("id_b"))
        .join(sets.select(F.col("id").alias("id_a"), F.col("s").alias("set_a")), F.col("a") == F.col("id_a"))
        .where(shared * 10_000 >= union * round(threshold * 10_000))
        .select("a", "b", "comp_a", "comp_b").distinct()
    )


def shingle_sets(docs: DataFrame, ids: DataFrame, id_col: str, text_col: str, words: int) -> DataFrame:
    def make() -> Callable:
        hasher = Hasher()
        return lambda id, text: (id, hasher.shingles(text, words).view(np.int64))

    wanted = text_bytes(docs, id_col, text_col).withColumn("id", F.col("id").cast("long")).join(small(ids), "id", "left_semi")
    return map_rows(wanted, make, "id long, s array<long>")


def unsettled(members: DataFrame, scratch: Scratch) -> DataFrame:
    """The buckets of a table with key and comp that hold two components or more."""
    mixed = members.groupBy("key").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x < y").select("key")
    return scratch.save(members.join(scratch.save(mixed), "key"))


def enough(most: Column, other_most: Column, n: Column, other_n: Column, threshold: float) -> Column:
    """Whether two sets that share at most ``most`` and ``other_most`` of their shingles can reach the threshold; true
    where a size is unknown."""
    shared = F.least(most, other_most)
    return F.coalesce(shared * 10_000 >= (n + other_n - shared) * round(threshold * 10_000), F.lit(True))


def with_partners(live: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch) -> DataFrame:
    """Leaves the members of buckets that can still have a link there, with ``most`` brought up to date.

    Of the shingles that a set shares with one other live set at most, a partner holds no more than the best such set.
    This bounds the similarity to all sets at least as large as the bucket's smallest. Copies that edits have moved too
    far go here, without being compared with each other.
    """
    mine = sets.join(live.select("id").distinct(), "id")
    held = mine.select("id", F.explode("s").alias("shingle")).groupBy("shingle").agg(
        F.count("*").alias("n"), F.min("id").alias("x"), F.max("id").alias("y"))
    ends = F.when(F.col("n") == 1, F.array(F.struct(F.col("x").alias("id"), F.lit(None).cast("long").alias("other")))).otherwise(
        F.array(F.struct(F.col("x").alias("id"), F.col("y").alias("other")), F.struct(F.col("y").alias("id"), F.col("x").alias("other"))))
    few = held.where("n <= 2").select(F.inline(ends)).groupBy("id", "other").agg(F.count("*").alias("n"))
    best = F.coalesce(F.max(F.when(F.col("other").isNotNull(), F.col("n"))), F.lit(0))
    alone = scratch.save(few.groupBy("id").agg((F.sum("n") - best).alias("alone")))
    members = scratch.save(live.join(alone, "id", "left").withColumn("most", F.col("n") - F.coalesce("alone", F.lit(0))))
    least = scratch.save(members.groupBy("key").agg(F.min(F.coalesce("n", F.lit(0))).alias("least")))
    most, least_n = F.col("most"), F.greatest("least", "most")
    return members.join(least, "key").where(enough(most, most, F.col("n"), least_n, threshold)).select(live.columns)


BLOCK, BLOCK_SHINGLES = 512, 500_000  # most members and shingles of a block
COLUMNS = 4_096  # elements of a membership table
WAVES = (1, 6)  # bands after which links contract the groups, before all bands are gone through


class Groups:
    """Components of documents that grow by rounds of comparisons within buckets."""

    def __init__(self, comp: DataFrame, sketched: DataFrame, sets: DataFrame, threshold: float, scratch: Scratch):
        self.comp, self.sketched, self.sets, self.threshold, self.scratch = comp, sketched, sets, threshold, scratch
        self.checked: DataFrame | None = None

    def named(self, members: DataFrame) -> DataFrame:
        """Members with their component as it is now; only buckets that hold two or more."""
        members = members.drop("comp").join(self.comp, "id")
        return unsettled(self.scratch.save(members), self.scratch)

    def compare(self, live: DataFrame, pivots: int) -> DataFrame:
        """Compares the first members of each bucket with its others, adds the links to the components and returns the
        members (key, id) that were compared with all others.

        The first members of a bucket are one row, and a member's partners from all its buckets come together before pairs
        are made: a group that meets in every band makes its pairs once, not once a band."""
        first = F.row_number().over(Window.partitionBy("key").orderBy("rank", "id"))
        chosen = self.scratch.save(live.withColumn("place", first).where(F.col("place") <= pivots).drop("place", "rank"))
        lists = self.scratch.save(chosen.groupBy("key").agg(F.collect_list(F.struct("id", "comp", "n", "most")).alias("firsts")))

        def apart(p: Column) -> Column:
            near = enough(F.col("most"), p["most"], F.col("n"), p["n"], self.threshold)
            return (p["id"] != F.col("id")) & (p["comp"] != F.col("comp")) & near

        others = F.transform(F.filter("firsts", apart), lambda p: F.struct(p["id"].alias("id"), p["comp"].alias("comp")))
        partners = live.join(lists, "key").select("id", "comp", others.alias("others")).where(F.size("others") > 0)
        partners = partners.groupBy("id", "comp").agg(F.array_distinct(F.flatten(F.collect_list("others"))).alias("others"))
        a, b = F.struct("id", "comp"), F.col("other")
        swap = F.col("id") > F.col("other.id")
        pairs = partners.select("id", "comp", F.explode("others").alias("other")).select(
            F.when(swap, b).otherwise(a).alias("a"), F.when(swap, a).otherwise(b).alias("b")
        ).selectExpr("a.id as a", "b.id as b", "a.comp as comp_a", "b.comp as comp_b").distinct()
        if self.checked is not None:
            pairs = pairs.join(self.checked, ["a", "b"], "left_anti")
        pairs = self.scratch.save(pairs)
        done = pairs.select("a", "b")
        self.checked = done if self.checked is None else self.checked.union(done)
        links = confirmed(self.scratch.save(likely(pairs, self.sketched, self.threshold)), self.sets, self.threshold)
        self.add(links.select(F.col("comp_a").alias("a"), F.col("comp_b").alias("b")).distinct())
        return chosen.select("key", "id")

    def add(self, links: DataFrame) -> None:
        """Joins the components (a, b)."""
        links = self.scratch.save(links)
        if not links.isEmpty():
            moved = components(links, self.scratch).select(F.col("node").alias("comp"), F.col("comp").alias("low"))
            self.comp = self.scratch.save(
                self.comp.join(moved, "comp", "left").select("id", F.coalesce("low", "comp").alias("comp")))

    def finish(self, live: DataFrame) -> None:
        """Compares all members of different components within each bucket, in blocks inside the tasks, which return a
        spanning set of links instead of pairs.

        What comes here are texts that the first members did not settle, such as copies that edits of their own have moved
        apart from each other: no bound below full sets tells which of them are linked."""
        held = self.scratch.save(live.select("key", "id", "comp").join(self.sets, "id"))
        blocks = F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum(F.size("s")) / BLOCK_SHINGLES)).alias("blocks")
        counts = self.scratch.save(held.groupBy("key").agg(blocks))
        own = F.pmod(F.xxhash64("id"), F.col("blocks"))
        dealt = held.join(counts, "key").withColumn("own", own).withColumn(
            "other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        dealt = dealt.withColumn("low", F.least("own", "other")).withColumn("high", F.greatest("own", "other"))
        threshold = round(self.threshold * 10_000)

        def linked(pdf: pd.DataFrame) -> pd.DataFrame:
            first, second = pdf["own"].to_numpy() == pdf["low"].iloc[0], pdf["own"].to_numpy() == pdf["high"].iloc[0]
            sets, comp = pdf["s"].to_list(), pdf["comp"].to_numpy()
            left, right = np.flatnonzero(first), np.flatnonzero(second)
            sizes = np.array([len(x) for x in sets])
            both = shared_counts([sets[i] for i in left], [sets[i] for i in right])
            union = sizes[left][:, None] + sizes[right][None] - both
            i, j = np.nonzero((both * 10_000 >= union * threshold) & (comp[left][:, None] != comp[right][None]))
            return pd.DataFrame(spanning(comp[left][i].tolist(), comp[right][j].tolist()), columns=["a", "b"]).astype("int64")

        links = dealt.select("key", "low", "high", "own", "comp", "s").groupBy("key", "low", "high").applyInPandas(linked, "a long, b long")
        self.add(links.distinct())


def shared_counts(left: list[np.ndarray], right: list[np.ndarray]) -> np.ndarray:
    """How many elements each set of one list shares with each of the other: products of membership tables, a range of the
    elements at a time."""
    out = np.zeros((len(left), len(right)), np.int64)
    if not left or not right:
        return out
    x, y = np.concatenate(left), np.concatenate(right)
    elements = np.intersect1d(x, y)
    rows = [np.repeat(np.arange(len(side)), [len(s) for s in side]) for side in (left, right)]
    kept = [np.isin(values, elements) for values in (x, y)]
    places = [np.searchsorted(elements, values[k]) for values, k in zip((x, y), kept)]
    rows = [r[k] for r, k in zip(rows, kept)]
    for at in range(0, len(elements), COLUMNS):
        tables = []
        for side, row, place in zip((left, right), rows, places):
            mine = (place >= at) & (place < at + COLUMNS)
            table = np.zeros((len(side), min(COLUMNS, len(elements) - at)), np.float32)
            table[row[mine], place[mine] - at] = 1
            tables.append(table)
        out += np.rint(tables[0] @ tables[1].T).astype(np.int64)
    return out


def spanning(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """The links that join something not joined by those before."""
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while root.setdefault(x, x) != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for x, y in zip(a, b):
        p, q = find(x), find(y)
        if p != q:
            root[p] = q
            out.append((x, y))
    return out


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = 5, threshold: float = 0.8
) -> DataFrame:
    """Groups of documents whose sets of distinct word shingles have a Jaccard similarity of at least ``threshold``.

    Returns one row for each input row: doc_id, n_shingles, component_id (the smallest id that can be reached over links),
    kept (the row's id is its component's). Letters A-Z are lower-cased; words are runs without ASCII white space; a text
    with fewer words is one shingle; without words (or null) it has none and is linked with nothing. Rows that share an id
    count as one document, linked if any of their texts is. A null id is linked with nothing: component null, kept true.

    Equal sets are one class, found by fingerprint. Of the classes, bands of SetSketch registers give candidate buckets
    (a pair at the threshold is missed with a probability of 1e-6), the joint likelihood estimate drops candidates far
    below the threshold, and full sets decide. A bucket's pairs are never written out: its most connected members are
    compared with the rest, and links contract components. A few bands go first, one member of a bucket each, so that a large
    group is one component before its other bands are looked at; then one member of every bucket. Of what is left, members that
    can have no link are dropped, and the others are compared with those of other components block by block inside the tasks.
    """
    spark = docs.sparkSession
    rows, count = banding(threshold)
    with Scratch(spark) as scratch:
        sketched = scratch.save(sketches(docs, id_col, text_col, words, rows, count))
        known = sketched.where("n > 0 and id is not null")
        classes = scratch.save(known.groupBy("f", "g").agg(F.min("id").alias("rep"), F.count("*").alias("size")).where("size > 1"))
        reps = known.select("id", "f", "g", "keys").join(classes, ["f", "g"], "left").where("rep is null or rep = id")
        keyed = scratch.save(reps.select("id", F.posexplode("keys").alias("band", "key")))
        shared = keyed.groupBy("key").agg(F.min("id").alias("x"), F.max("id").alias("y"), F.count("*").alias("size"))
        shared = scratch.save(shared.where("x < y").select("key", "size"))
        met = scratch.save(keyed.join(shared, "key"))
        # first the members of the largest buckets: the texts that others are copies of
        ranks = scratch.save(met.groupBy("id").agg((-F.sum("size")).alias("rank")))
        sets = scratch.save(shingle_sets(docs, ranks.select("id"), id_col, text_col, words))
        one = F.when(F.count("*") == 1, F.min(F.size("s"))).cast("long")  # unknown for ids with several texts
        sizes = scratch.save(sets.groupBy("id").agg(one.alias("n")).join(ranks, "id"))
        members = scratch.save(met.join(sizes, "id").select("band", "key", "id", "rank", "n", F.col("n").alias("most")))
        groups = Groups(ranks.select("id", F.col("id").alias("comp")), sketched, sets, threshold, scratch)
        for low, high in zip((0, *WAVES), WAVES):
            live = groups.named(members.where((F.col("band") >= low) & (F.col("band") < min(high, count))).drop("band"))
            if not live.isEmpty():
                groups.compare(live, 1)
        live = groups.named(members.drop("band"))
        if not live.isEmpty():
            done = groups.compare(live, 1)
            live = groups.named(live.join(done, ["key", "id"], "left_anti"))
        if not live.isEmpty():
            live = unsettled(with_partners(live, sets, threshold, scratch), scratch)
        if not live.isEmpty():
            groups.finish(live)
        lone = known.select("id", "f", "g").join(groups.comp, "id").where("comp != id").select("f", "g", "comp")
        copies = classes.join(groups.comp, classes.rep == groups.comp.id, "left").select("f", "g", F.coalesce("comp", "rep").alias("comp"))
        labels = scratch.save(lone.union(copies).groupBy("f", "g").agg(F.min("comp").alias("comp")))
        rows_out = sketched.join(labels, ["f", "g"], "left").select(
            F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.expr("if(id is null, null, coalesce(comp, id))").alias("component_id")
        )
        return write_and_read(rows_out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id"))))


def first_of_groups(docs: DataFrame, words: int = 5, threshold: float = 0.8) -> DataFrame:
    """The documents without near duplicates: one document of each group stays, with all its columns.

    Rows that repeat a doc_id are one document, of which one row stays; rows without doc_id stay."""
    found = near_duplicates(docs, words=words, threshold=threshold)
    gone = found.where("not kept").select("doc_id").distinct()
    repeated = found.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    with Scratch(docs.sparkSession) as scratch:
        left = docs.join(small(scratch.save(gone)), "doc_id", "left_anti")
        again = small(scratch.save(repeated))
        once = left.join(again, "doc_id", "left_anti")
        return write_and_read(once.unionByName(left.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])).select(docs.columns))
