"""Grouped reports."""

from __future__ import annotations

from collections.abc import Sequence
from math import inf

from pyspark.sql import Column, DataFrame, Window as W, functions as F

# Left-closed price bins.
PRICE_EDGES = (0, 250, 500, 750, 1000, 1500, 2000, inf)
PRICE_LABELS = ("<250", "250-500", "500-750", "750-1000", "1000-1500", "1500-2000", ">2000")


def mean_by(df: DataFrame, keys: Sequence[str], value: str, name: str = "average") -> DataFrame:
    return df.groupBy(*keys).agg(F.avg(value).alias(name))


def top_mean(df: DataFrame, key: str, value: str, n: int = 10, name: str = "average") -> DataFrame:
    """The ``n`` keys with the highest mean."""
    return mean_by(df, [key], value, name).orderBy(F.desc(name), F.asc(key)).limit(n)


def count_by(df: DataFrame, key: str, value: str, name: str = "n") -> DataFrame:
    """Non-null values per key."""
    return df.groupBy(key).agg(F.count(value).alias(name))


def top_count(df: DataFrame, key: str, value: str, n: int = 10, name: str = "n") -> DataFrame:
    """The ``n`` keys with the most non-null values."""
    return count_by(df, key, value, name).orderBy(F.desc(name), F.asc(key)).limit(n)


def ideal_groups(df: DataFrame, key: str, value: str, counted: str, n: int = 10) -> DataFrame:
    """High mean first, few members first among equals."""
    grouped = df.groupBy(key).agg(F.avg(value).alias("average"), F.count(counted).alias("n"))
    return grouped.orderBy(F.desc("average"), F.asc("n"), F.asc(key)).limit(n)


def sum_by(df: DataFrame, key: str, value: str, name: str = "total") -> DataFrame:
    """Sum per key; decimals stay decimals."""
    return df.groupBy(key).agg(F.sum(value).alias(name))


def overall_mean(df: DataFrame, value: str, name: str = "average") -> DataFrame:
    return df.agg(F.avg(value).alias(name))


def count_by_case(df: DataFrame, case: Column, value: str, label: str, name: str = "n") -> DataFrame:
    """Count per value of a CASE expression."""
    return df.groupBy(case.alias(label)).agg(F.count(value).alias(name))


def bin_label(value: str, edges: Sequence[float] = PRICE_EDGES, labels: Sequence[str] = PRICE_LABELS) -> Column:
    """Label of the left-closed bin a value falls in; NULL outside the edges."""
    x = F.col(value)
    out = F.when(x < edges[0], None)
    for upper, label in zip(edges[1:], labels):
        out = out.when(x < upper if upper != inf else x.isNotNull(), label)
    return out


def bin_mean(
    df: DataFrame, x: str, value: str, edges: Sequence[float] = PRICE_EDGES, labels: Sequence[str] = PRICE_LABELS,
) -> DataFrame:
    """(bin, average), every bin present, highest mean first and empty bins last."""
    spark = df.sparkSession
    bins = spark.createDataFrame([(label,) for label in labels], "bin string")
    means = df.filter(F.col(value).isNotNull()).groupBy(bin_label(x, edges, labels).alias("bin")).agg(
        F.avg(value).alias("average")
    )
    return bins.join(means, "bin", "left").orderBy(F.desc_nulls_last("average"), "bin")


def top_per_segment(df: DataFrame, segment: str, value: str, tie: str, n: int = 5) -> DataFrame:
    """Best ``n`` rows per segment. The filter on the rank lets each task keep ``n`` rows per segment before the
    shuffle, so a few huge segments are no problem."""
    w = W.partitionBy(segment).orderBy(F.desc(value), F.asc(tie))
    kept = df.filter(F.col(value).isNotNull() & F.col(segment).isNotNull())
    return kept.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= n)
