"""Mixing sources to target weights by capped water-filling."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.tables import Scratch, small
from millrace.operators.ordering import ordered_index
from millrace.session import write_and_read

WORD = r"[^\x20\x09-\x0D]+"
WEIGHTS = (5, 2, 1)
EPOCHS = 3
DIGITS = 3  # hexadecimal digits a level of the sampling threshold; two levels


def size_of(text: str) -> Column:
    return F.coalesce(F.regexp_count(F.col(f"`{text}`"), F.lit(WORD)), F.lit(0)).cast("long")


def draw_of(id_col: str, text_col: str, seed: int) -> Column:
    """A number below 16^6 that depends on the id, the text and the seed alone, so that rows that share an id, or have none,
    are drawn one by one unless they are equal."""
    text = F.md5(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")))
    name = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")), F.lit(":"), text)
    return F.conv(F.substring(F.md5(name), 1, 2 * DIGITS), 16, 10).cast("long")


def keyed(source: str) -> list[Column]:
    """A source as two columns without nulls, for joins."""
    return [F.col(f"`{source}`").isNull().alias("_no_source"), F.coalesce(F.col(f"`{source}`"), F.lit("")).alias("_source")]


def water_filling(sources: DataFrame, epochs: int) -> DataFrame:
    """Adds ``target`` to the written table of sources (source_size, weight): shares of the total by weight, none above
    ``epochs`` times its size. What is above goes to the others by weight, until none is; each round is one small
    aggregate, in whole numbers."""
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    cap = F.col("source_size") * epochs
    level, shares = 0, 0
    while True:
        over = F.lit(level).cast("decimal(24,0)") * F.col("weight") > cap.cast("decimal(24,0)") * F.lit(shares).cast("decimal(14,0)")
        over = over if shares else F.lit(False)
        used, left = sources.agg(
            F.coalesce(F.sum(F.when(over, cap)), F.lit(0)), F.coalesce(F.sum(F.when(~over, F.col("weight"))), F.lit(0))
        ).first()
        if (total - used, left) == (level, shares) or not left:
            return sources.withColumn("target", F.when(over, cap.cast("double")).otherwise(
                F.lit(float(level)) * F.col("weight") / F.lit(float(max(1, shares)))))
        level, shares = total - used, left


def plan(sized: DataFrame, weights: Sequence[int], epochs: int, scratch: Scratch) -> DataFrame:
    """One row a source: _no_source, _source, source_size, target, whole repetitions and the threshold below which a
    document's draw earns it one more.

    The fraction of a repetition goes to the documents with the lowest draws, up to the words that are wanted. Where
    that is, follows from sums by the first and then by the next digits of the draw: no order over documents.
    """
    keys = ["_no_source", "_source"]
    sums = scratch.save(sized.groupBy(*keys).agg(F.sum("size").alias("source_size")))
    ranked = ordered_index(sums, keys, "_rank")
    chosen = F.element_at(F.array(*map(F.lit, weights)), (F.col("_rank") % len(weights) + 1).cast("int"))
    sources = scratch.save(ranked.withColumn("weight", chosen.cast("long")).drop("_rank"))
    sources = water_filling(sources, epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    sources = sources.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size"))
    sources = scratch.save(sources)
    base = 16**DIGITS

    def crossing(rows: DataFrame, part: Column) -> DataFrame:
        """For each source the part of the draws in which the running sum of sizes passes ``rest``."""
        parts = rows.groupBy(*keys, part.alias("part")).agg(F.sum("size").alias("size"))
        running = F.sum("size").over(Window.partitionBy(*keys).orderBy("part"))
        return parts.withColumn("upto", running).join(small(sources.select(*keys, "rest")), keys).where(
            (F.col("upto") - F.col("size") <= F.col("rest")) & (F.col("rest") < F.col("upto")))

    coarse = scratch.save(crossing(sized, F.floor(F.col("draw") / base)).select(
        *keys, F.col("part").alias("first"), (F.col("upto") - F.col("size")).alias("before")))
    inside = sized.join(small(coarse), keys).where(F.floor(F.col("draw") / base) == F.col("first"))
    parts = inside.groupBy(*keys, "first", "before", (F.col("draw") % base).alias("part")).agg(F.sum("size").alias("size"))
    running = F.col("before") + F.sum("size").over(Window.partitionBy(*keys).orderBy("part"))
    fine = parts.withColumn("upto", running).join(small(sources.select(*keys, "rest")), keys).where(
        (F.col("upto") - F.col("size") <= F.col("rest")) & (F.col("rest") < F.col("upto")))
    nearer = (F.col("upto") - F.col("rest") < F.col("rest") - (F.col("upto") - F.col("size"))).cast("long")
    limits = scratch.save(fine.select(*keys, (F.col("first") * base + F.col("part") + nearer).alias("limit")))
    return sources.join(small(limits), keys, "left").select(
        *keys, "source_size", "target", "whole", F.coalesce("limit", F.lit(0)).alias("limit"))


def repeats() -> Column:
    return (F.col("whole") + (F.col("draw") < F.col("limit")).cast("long")).alias("repeats")


def mix_sizes(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = 42,
) -> DataFrame:
    """One row for each input row: doc_id, source, size (words), source_size, target, repeats, taken = repeats * size.

    Sources in code point order, null last, have the weights in turn and share the words of all documents; none gets more
    than ``epochs`` times its own. Every document is taken whole: ``floor(target / source_size)`` times, and once more if
    its seeded draw is low enough; the words of a source meet its target to within about half a document. Draws depend on
    the id only, so reruns agree, rows that repeat an id go together, and null ids share one draw. Texts that are null or
    without words have size 0; a source without words has target 0.
    """
    with Scratch(docs.sparkSession) as scratch:
        sized = scratch.save(docs.select(
            F.col(f"`{id_col}`").alias("doc_id"), F.col(f"`{source_col}`").alias("source"), *keyed(source_col),
            size_of(text_col).alias("size"), draw_of(id_col, text_col, seed).alias("draw")))
        found = plan(sized, weights, epochs, scratch)
        out = sized.join(small(scratch.save(found)), ["_no_source", "_source"]).select(
            "doc_id", "source", "size", "source_size", "target", repeats())
        return write_and_read(out.withColumn("taken", F.col("repeats") * F.col("size")))


def mixed_documents(
    docs: DataFrame, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    weights: Sequence[int] = WEIGHTS, epochs: int = EPOCHS, seed: int = 42,
) -> DataFrame:
    """The mix itself: every document as often as it is taken, with all its columns and ``repeat`` (1, 2, ...)."""
    with Scratch(docs.sparkSession) as scratch:
        sized = scratch.save(docs.select(*keyed(source_col), size_of(text_col).alias("size"), draw_of(id_col, text_col, seed).alias("draw")))
        found = small(scratch.save(plan(sized, weights, epochs, scratch)))
        row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), *keyed(source_col),
                          draw_of(id_col, text_col, seed).alias("draw"))
        taken = row.join(found, ["_no_source", "_source"]).select("row", repeats()).where("repeats > 0")
        # a new name where the documents have a column of that name
        name = next(n for n in ("repeat", *(f"repeat_{i}" for i in range(len(docs.columns) + 1))) if n not in docs.columns)
        copies = taken.select("row", F.explode(F.sequence(F.lit(1), F.col("repeats").cast("int"))).alias(name))
        return write_and_read(copies.select("row.*", name))
