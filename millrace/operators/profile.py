"""Profiling: nulls, extents, summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, functions as F

from millrace.operators.quantiles import exact_quantiles

QUARTILES = (0.25, 0.5, 0.75)


def null_counts(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """(column, n_null) in one pass."""
    columns = list(columns or df.columns)
    one_row = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns])
    return one_row.unpivot([], columns, "column", "n_null")


def row_null_counts(df: DataFrame, key: str, columns: Sequence[str] | None = None) -> DataFrame:
    """(key, n_null) for rows with at least one NULL."""
    columns = list(columns or [c for c in df.columns if c != key])
    total = sum((F.col(c).isNull().cast("int") for c in columns), F.lit(0))
    return df.select(key, total.alias("n_null")).filter(F.col("n_null") > 0)


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """count, mean, sample deviation, min, exact quartiles and max, one row per column."""
    quartiles = exact_quantiles(df, columns, QUARTILES)
    stats = [
        F.struct(
            F.lit(c).alias("column"),
            F.count(c).alias("count"),
            F.avg(c).alias("mean"),
            F.stddev_samp(c).alias("std"),
            F.min(c).cast("double").alias("min"),
            *[F.lit(q).cast("double").alias(f"p{int(p * 100)}") for p, q in zip(QUARTILES, quartiles[c])],
            F.max(c).cast("double").alias("max"),
        )
        for c in columns
    ]
    return df.agg(F.array(*stats).alias("s")).selectExpr("inline(s)")


def table_schema(df: DataFrame) -> DataFrame:
    """(column, type) in table order."""
    return df.sparkSession.createDataFrame(df.dtypes, "column string, type string")


def table_extent(df: DataFrame, order: str) -> DataFrame:
    """Row count and the first and last value of ``order``."""
    return df.agg(F.count("*").alias("n_rows"), F.min(order).alias("first"), F.max(order).alias("last"))


def distinct_values(df: DataFrame, column: str, row_id: str | None = None) -> DataFrame:
    """Distinct values; with ``row_id`` each comes with the row it first appears in."""
    if row_id is None:
        return df.select(column).distinct()
    return df.groupBy(column).agg(F.min(row_id).alias("first_row"))


def count_outside(df: DataFrame, column: str, lower=None, upper=None) -> DataFrame:
    """How many values lie outside [lower, upper]."""
    outside = F.lit(False)
    if lower is not None:
        outside = outside | (F.col(column) < lower)
    if upper is not None:
        outside = outside | (F.col(column) > upper)
    return df.agg(F.count_if(outside).alias("n_outside"))


def box_summary(df: DataFrame, columns: Sequence[str], reach: float = 1.5) -> DataFrame:
    """Quartiles, whiskers (extreme values inside the fences) and the number of points beyond them."""
    quartiles = exact_quantiles(df, columns, QUARTILES)
    boxes = []
    for c in columns:
        q1, q2, q3 = quartiles[c]
        if q1 is None:
            low = high = F.lit(None).cast("double")
        else:
            low, high = F.lit(q1 - reach * (q3 - q1)), F.lit(q3 + reach * (q3 - q1))
        x = F.col(c).cast("double")
        boxes.append(
            F.struct(
                F.lit(c).alias("column"),
                F.min(F.when(x >= low, x)).alias("whisker_low"),
                F.lit(q1).cast("double").alias("q1"),
                F.lit(q2).cast("double").alias("median"),
                F.lit(q3).cast("double").alias("q3"),
                F.max(F.when(x <= high, x)).alias("whisker_high"),
                F.count_if((x < low) | (x > high)).alias("n_outliers"),
            )
        )
    return df.agg(F.array(*boxes).alias("b")).selectExpr("inline(b)")


def quantiles(df: DataFrame, columns: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(column, p, value), exact."""
    exact = exact_quantiles(df, columns, probabilities)
    rows = [(c, float(p), v) for c in columns for p, v in zip(probabilities, exact[c])]
    return df.sparkSession.createDataFrame(rows, "column string, p double, value double")
