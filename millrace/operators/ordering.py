"""Order-dependent building blocks that never put one key's (or the whole table's) rows in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.session import cut_lineage

def ordered_index(df: DataFrame, order_by: Sequence[str | Column], name: str = "row_index") -> DataFrame:
    """Contiguous 0-based position in a total order.

    One range shuffle sorts the rows; ``monotonically_increasing_id`` then holds (partition, offset), the sorted
    rows are checkpointed so both are fixed, and the start of each partition comes from one count per partition.
    The unpartitioned window below sees one row per partition.
    """
    local = F.col("_mid").bitwiseAND(F.lit((1 << 33) - 1))
    sorted_rows = cut_lineage(df.orderBy(*order_by).withColumn("_mid", F.monotonically_increasing_id()))
    sorted_rows = sorted_rows.withColumn("_pid", F.shiftright("_mid", 33))
    starts = (
        sorted_rows.groupBy("_pid")
        .agg(F.count("*").alias("_n"))
        .withColumn("_start", F.sum("_n").over(W.orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)))
        .select("_pid", F.coalesce("_start", F.lit(0)).alias("_start"))
    )
    return (
        sorted_rows.join(F.broadcast(starts), "_pid")  # one row per partition
        .withColumn(name, F.col("_start") + local)
        .drop("_pid", "_mid", "_start")
    )


def _in_order(df: DataFrame, keys: Sequence[str], order: str) -> DataFrame:
    """Rows in order of the keys and ``order``, with their place (``_mid``) and partition (``_pid``) of one range shuffle.

    Partitions are ranges of (keys, order), so a key of any size is cut where it has to be and none is known beforehand."""
    rows = cut_lineage(df.orderBy(*keys, order).withColumn("_mid", F.monotonically_increasing_id()))
    return rows.withColumn("_pid", F.shiftright("_mid", 33))


def _carried(rows: DataFrame, keys: Sequence[str], value: str, skip_nulls: bool) -> DataFrame:
    """(_pid, _key, _carry): what the first key of a partition inherits from the partitions before it.

    A key goes over a partition's edge only as its first or its last key. Those two report their last value, and a window over
    these reports, two rows a partition at most, passes it on."""
    own = F.struct(*keys) if keys else F.struct(F.lit(0))
    ends = rows.groupBy("_pid").agg(F.min_by(own, "_mid").alias("_head"), F.max_by(own, "_mid").alias("_foot"))
    edge = rows.join(F.broadcast(ends), "_pid")  # one row per partition
    edge = edge.withColumn("_key", own).filter(F.col("_key").eqNullSafe(F.col("_head")) | F.col("_key").eqNullSafe(F.col("_foot")))
    at = F.when(F.col(value).isNotNull(), F.col("_mid")) if skip_nulls else F.col("_mid")
    opens = F.max(F.col("_key").eqNullSafe(F.col("_head"))).alias("_opens")
    tails = edge.groupBy("_pid", "_key").agg(F.max_by(value, at).alias("_tail"), opens)
    before = W.partitionBy("_key").orderBy("_pid").rowsBetween(W.unboundedPreceding, -1)
    carried = tails.withColumn("_carry", F.last("_tail", ignorenulls=skip_nulls).over(before))
    return carried.filter("_opens").select("_pid", "_key", "_carry")


def _scan(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str, skip_nulls: bool) -> DataFrame:
    keys = list(keys)
    own = F.struct(*keys) if keys else F.struct(F.lit(0))
    rows = _in_order(df, keys, order)
    carry = _carried(rows, keys, value, skip_nulls)
    within = W.partitionBy("_pid", *keys).orderBy("_mid")
    if skip_nulls:
        found = F.last(value, ignorenulls=True).over(within.rowsBetween(W.unboundedPreceding, W.currentRow))
        open_ = F.col("_within").isNull()
    else:
        found = F.lag(value).over(within)
        open_ = F.col("_first")
        rows = rows.withColumn("_first", F.row_number().over(within) == 1)
    scanned = rows.withColumn("_within", found).join(F.broadcast(carry), "_pid", "left")  # one row per partition
    inherited = F.when(open_ & own.eqNullSafe(F.col("_key")), F.col("_carry")).otherwise(F.col("_within"))
    return scanned.withColumn(name, inherited).drop("_within", "_first", "_mid", "_pid", "_key", "_carry")


def with_previous(df: DataFrame, keys: Sequence[str], order: str, value: str, name: str) -> DataFrame:
    """``lag(value)`` per key along ``order``, as a segmented scan: a task sees a partition's rows, whatever the sizes of keys."""
    return _scan(df, keys, order, value, name, skip_nulls=False)


def forward_fill(df: DataFrame, value: str, order: str, keys: Sequence[str] = (), name: str | None = None) -> DataFrame:
    """Last non-null value so far per key (or over the whole table when ``keys`` is empty), by the same scan."""
    return _scan(df, keys, order, value, name or value, skip_nulls=True)
