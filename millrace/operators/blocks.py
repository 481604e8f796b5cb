"""Spreading the rows of large groups over several tasks before two frames meet."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from millrace.session import write_and_read

BLOCK = 4_096
TURN = 64  # blocks of the right side that one task goes through


def packed_vectors(df: DataFrame, names: Sequence[str], block: int = BLOCK) -> DataFrame:
    """(block, names, v): up to ``block`` rows as arrays of their columns ``names`` and the bytes of their vectors ``_v``. Rows keep
    their partitions and their order there."""
    names = list(names)

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held, n = [], 0

        def full(rows: pd.DataFrame) -> pd.DataFrame:
            return pd.DataFrame({**{c: [list(rows[c])] for c in names}, "v": [np.stack(rows["_v"].to_numpy()).astype("f8").tobytes()]})

        for pdf in frames:
            held, n = [*held, pdf], n + len(pdf)
            if n >= block:
                rows = pd.concat(held)
                while len(rows) >= block:
                    yield full(rows[:block])
                    rows = rows[block:]
                held, n = [rows], len(rows)
        if n:
            yield full(pd.concat(held))

    schema = T.StructType([T.StructField(c, T.ArrayType(df.schema[c].dataType)) for c in names]).add("v", "binary")
    rows = df.select(*names, "_v").mapInPandas(pack, schema)
    return write_and_read(rows.withColumn("block", F.monotonically_increasing_id()))


def block_pairs(left: DataFrame, right: DataFrame, on: Column | None = None, turn: int = TURN) -> DataFrame:
    """Every block of one side beside every block of the other, columns with ``_a`` and ``_b``: a Cartesian product of written
    tables. A task takes the pairs of a left block and up to about ``turn`` right ones one after the other."""
    a, b = (side.select(*[F.col(c).alias(f"{c}_{name}") for c in side.columns]) for side, name in ((left, "a"), (right, "b")))
    parts = max(1, -(-right.count() // turn))
    a, b = a.repartition(max(1, left.count())), (b.coalesce(parts) if turn == TURN else b.repartition(parts)).hint("shuffle_replicate_nl")
    return a.crossJoin(b) if on is None else a.join(b, on)


def pair_blocks(
    left: DataFrame, right: DataFrame, keys: Sequence[str], left_id: str, right_id: str, block: int = BLOCK,
    left_sizes: DataFrame | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Add ``_lb`` and ``_rb`` so that joining on ``keys + [_lb, _rb]`` equals joining on ``keys``, while no
    (key, _lb, _rb) group holds many more than ``block`` rows of either side.

    Only keys above the block size are split: their rows are hashed into blocks of their own side and repeated
    once per block of the other side. Everything else passes through with block 0. ``left_sizes`` (keys, ``n``) saves
    counting the left side when its group sizes are known already.
    """
    keys = list(keys)
    if left_sizes is None:
        left_sizes = left.groupBy(*keys).agg(F.count("*").alias("n"))
    n_left = left_sizes.select(*keys, F.ceil(F.col("n") / block).alias("_nl"))
    n_right = right.groupBy(*keys).agg(F.ceil(F.count("*") / block).alias("_nr"))
    big = n_left.join(n_right, keys).filter((F.col("_nl") > 1) | (F.col("_nr") > 1))

    def placed(df, row_id, own, n_own, other, n_other):
        known = df.join(big, keys, "left")
        mine = F.pmod(F.xxhash64(row_id), F.coalesce(n_own, F.lit(1)))
        others = F.explode(F.sequence(F.lit(0).cast("long"), F.coalesce(n_other, F.lit(1)) - 1))
        return known.withColumn(own, mine).withColumn(other, others).drop("_nl", "_nr")

    return (
        placed(left, left_id, "_lb", F.col("_nl"), "_rb", F.col("_nr")),
        placed(right, right_id, "_rb", F.col("_nr"), "_lb", F.col("_nl")),
    )


def shuffled(df: DataFrame) -> DataFrame:
    """For joins inside loops on tables that grow with the rows: never sent through the driver. Each alone may be below Spark's limit
    for a broadcast; over the rounds they are not."""
    return df.hint("merge")


HOT_SHARE = 1_000
HOT_ROWS = 1_000_000


def salted_lookup(
    df: DataFrame, table: DataFrame, key: str, size: str, row_id: str | Column, hot_rows: int = HOT_ROWS,
    hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Inner join with a table that is unique on ``key`` and knows in ``size`` how many rows of ``df`` each key has.

    Keys above both ``hot_rows`` and 1/``hot_share`` of all rows are split by a hash of ``row_id``. There are
    fewer than ``hot_share`` of them by arithmetic, which bounds the broadcast list of hot keys. Without such keys it
    is an ordinary join. ``table`` is read more than once, so pass a materialised one.
    """
    total, largest = table.agg(F.sum(size), F.max(size)).first()
    part = max(hot_rows, (total or 0) // hot_share + 1)
    if (largest or 0) <= part:
        return df.join(table, key)
    salts = F.ceil(F.col(size) / F.lit(part))
    hot = table.filter(F.col(size) > part).select(key, salts.alias("_salts"))
    salt = F.pmod(F.xxhash64(row_id), F.coalesce("_salts", F.lit(1)))
    left = df.join(F.broadcast(hot), key, "left").withColumn("_salt", salt).drop("_salts")
    spread = F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(salts, F.lit(1)) - 1))
    return left.join(table.withColumn("_salt", spread), [key, "_salt"]).drop("_salt")
