"""Row- and table-level cleaning."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from millrace.operators.ordering import forward_fill as ffill  # noqa: F401
from millrace.operators.quantiles import exact_quantiles


def dedupe_rows(df: DataFrame) -> DataFrame:
    """One copy of every distinct row; duplicates collapse before the shuffle."""
    return df.distinct()


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once (the check behind a declared primary key)."""
    return df.groupBy(*keys).agg(F.count("*").alias("n_rows")).filter(F.col("n_rows") > 1)


def dedupe_first(df: DataFrame, keys: Sequence[str | Column], order_by: Sequence[str | Column]) -> DataFrame:
    """First row per key along ``order_by``. Spark keeps one row per key in each task before the shuffle, so a
    key that fills a third of the table is no heavier than any other."""
    w = W.partitionBy(*keys).orderBy(*order_by)
    return df.withColumn("_rn", F.row_number().over(w)).filter(F.col("_rn") == 1).drop("_rn")


def fill_mean(df: DataFrame, column: str) -> DataFrame:
    """NULL -> mean of the column."""
    return df.withColumn(column, F.coalesce(column, df.agg(F.avg(column)).scalar()))


def fill_median(df: DataFrame, column: str, approximate: bool = False) -> DataFrame:
    """NULL -> median of the column, exact unless asked otherwise."""
    if approximate:
        median = df.agg(F.percentile_approx(column, 0.5, 10_000)).scalar()
    else:
        median = F.lit(exact_quantiles(df, [column], [0.5])[column][0]).cast("double")
    return df.withColumn(column, F.coalesce(F.col(column), median))


def fill_constant(df: DataFrame, value, columns: Sequence[str] | None = None) -> DataFrame:
    """NULL -> constant in the columns whose type fits the constant."""
    return df.fillna(value, subset=list(columns) if columns else None)


def rename_columns(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def tidy_headers(df: DataFrame) -> DataFrame:
    """Strip header names, first letter upper case and the rest lower case."""
    return df.toDF(*[c.strip().capitalize() for c in df.columns])


def keep_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Those of ``columns`` that exist, in the order given."""
    present = set(df.columns)
    return df.select(*[f"`{c}`" for c in columns if c in present])


def drop_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Everything but ``columns``; names that do not exist are ignored."""
    return df.drop(*columns)
