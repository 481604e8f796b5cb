"""Keyed price series and single ordered series."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window as W, functions as F

from millrace.functions import ratio_change
from millrace.operators.ordering import ordered_index, with_previous
from millrace.session import write_and_read

TRADING = ("ticker", "date", "close")
LOOKBACK = 60
HORIZONS = (1, 3, 7)
TINY = 1e-12  # a variance below this share of the mean square is rounding


# --- keyed series -----------------------------------------------------------------------------------------

def pct_change(
    df: DataFrame, key: str = "ticker", order: str = "date", value: str = "close", name: str = "daily_return"
) -> DataFrame:
    """Return against the key's previous row; NULL on the first row. Rows without a key are left out."""
    rows = with_previous(df.filter(F.col(key).isNotNull()), [key], order, value, "_previous")
    return rows.withColumn(name, ratio_change(value, "_previous")).drop("_previous")


def first_last(df: DataFrame, keys: Sequence[str], order: str = "date", value: str = "close") -> DataFrame:
    """First and last non-null value per key along ``order``; reduces before the shuffle."""
    when = F.when(F.col(value).isNotNull(), F.col(order))
    return (
        df.dropna(subset=list(keys))
        .groupBy(*keys)
        .agg(F.min_by(value, when).alias("first"), F.max_by(value, when).alias("last"))
    )


def total_return(df: DataFrame, keys: Sequence[str] = ("ticker",), order: str = "date", value: str = "close"):
    """(last - first) / first per key."""
    ends = first_last(df, keys, order, value)
    return ends.withColumn("return", F.try_divide(F.col("last") - F.col("first"), F.col("first")))


def volatility(returns: DataFrame, key: str = "ticker", value: str = "daily_return", n: int | None = 10) -> DataFrame:
    """Sample deviation of the returns, highest first, keys without one left out."""
    spread = returns.groupBy(key).agg(F.stddev_samp(value).alias("volatility")).filter("volatility is not null")
    ordered = spread.orderBy(F.desc("volatility"), F.asc(key))
    return ordered if n is None else ordered.limit(n)


def top_keys(df: DataFrame, key: str, value: str, n: int = 5) -> DataFrame:
    """The ``n`` keys with the highest value."""
    return df.filter(F.col(value).isNotNull()).orderBy(F.desc(value), F.asc(key)).limit(n).select(key)


def cumulative_return(
    df: DataFrame, n: int = 5, key: str = "ticker", order: str = "date", value: str = "close"
) -> DataFrame:
    """Return against the first price, for the ``n`` keys with the best total return."""
    best = total_return(df, [key], order, value)
    best = best.filter("return is not null").orderBy(F.desc("return"), F.asc(key)).limit(n)
    base = best.select(key, F.col("first").alias("baseline"))
    change = F.try_divide(F.col(value) - F.col("baseline"), F.col("baseline"))
    return df.join(F.broadcast(base), key).withColumn("cum_return", change)  # base has n rows


def monthly_return(df: DataFrame, key: str = "ticker", order: str = "date", value: str = "close") -> DataFrame:
    """Percent change from the first to the last price of each (month, key)."""
    months = df.withColumn("month", F.date_format(order, "yyyy-MM"))
    out = total_return(months, ["month", key], order, value)
    return out.withColumn("return", F.col("return") * 100)


def gainers_losers(monthly: DataFrame, n: int = 5, key: str = "ticker") -> DataFrame:
    """Top and bottom ``n`` per month; with fewer than ``2n`` keys a key may be on both sides."""
    # NULL returns sort last on the way down, so they are the first to be counted among the losers.
    down = W.partitionBy("month").orderBy(F.desc_nulls_last("return"), F.asc(key))
    up = W.partitionBy("month").orderBy(F.asc_nulls_first("return"), F.desc(key))
    gainers = monthly.withColumn("rank", F.row_number().over(down)).filter(F.col("rank") <= n)
    losers = monthly.withColumn("rank", F.row_number().over(up)).filter(F.col("rank") <= n)
    return gainers.withColumn("side", F.lit("gainer")).unionByName(losers.withColumn("side", F.lit("loser")))


def join_sector(returns: DataFrame, sectors: DataFrame, key: str = "ticker") -> DataFrame:
    """Add the sector; keys without one are ``Other``. Spark picks a broadcast when the dimension is small."""
    return returns.join(sectors, key, "left").withColumn("sector", F.coalesce("sector", F.lit("Other")))


def sector_rollup(returns: DataFrame, key: str = "ticker") -> DataFrame:
    """Mean return and the member list of every sector, best first."""
    out = returns.groupBy("sector").agg(
        F.avg("return").alias("average_return"), F.concat_ws(", ", F.sort_array(F.collect_list(key))).alias("members")
    )
    return out.orderBy(F.desc("average_return"), F.asc("sector"))


def date_grid(df: DataFrame, order: str = "date") -> DataFrame:
    """(date, position, previous date). One row per calendar day at most, so the global window stays small."""
    days = df.select(F.col(order).cast("date").alias(order)).distinct()
    w = W.orderBy(order)
    return days.select(order, F.row_number().over(w).alias("_pos"), F.lag(order).over(w).alias("_previous_date"))


def grid_return(
    df: DataFrame, pad: bool = False, key: str = "ticker", order: str = "date", value: str = "close"
) -> DataFrame:
    """Return against the previous date of the whole grid instead of the key's own previous row.

    Without ``pad`` a key missing on the previous grid date has no return; the output has the priced rows.
    Timestamps count by their date. With ``pad`` gaps repeat the last price, and the output has every grid date from the key's first price on.
    No date x key product is formed: prices look up their previous grid date, or fill their own gap.
    """
    df = df.withColumn(order, F.col(order).cast("date"))
    prices = df.filter(F.col(key).isNotNull() & F.col(value).isNotNull())
    grid = date_grid(df, order)
    dated = prices.join(grid, order)
    if not pad:
        before = prices.select(key, F.col(order).alias("_previous_date"), F.col(value).alias("_previous"))
        joined = dated.join(before, [key, "_previous_date"], "left")
        return joined.select(key, order, value, ratio_change(value, "_previous").alias("grid_return"))
    # Look from the next price back over the gap: the previous price holds until the day before the next one.
    both = dated.withColumn("_own", F.struct("_pos", F.col(value).alias("_close")))
    gaps = with_previous(both, [key], order, "_own", "_before")
    gaps = gaps.withColumns({"_from": F.col("_before._pos"), "_held": F.col("_before._close")})
    inner = gaps.filter(F.col("_from") < F.col("_pos") - 1).select(
        key, F.explode(F.sequence(F.col("_from") + 1, F.col("_pos") - 1)).alias("_pos"), F.col("_held").alias(value),
        F.lit(0.0).alias("grid_return"),
    )
    last = dated.groupBy(key).agg(F.max_by(value, "_pos").alias(value), F.max("_pos").alias("_from"))
    end = grid.agg(F.max("_pos")).scalar()
    tail = last.withColumn("_to", end).filter("_from < _to").select(
        key, F.explode(F.sequence(F.col("_from") + 1, F.col("_to"))).alias("_pos"), value, F.lit(0.0).alias("grid_return")
    )
    own = gaps.select(key, order, value, ratio_change(value, "_held").alias("grid_return"))
    padded = inner.unionByName(tail).join(grid.select("_pos", order), "_pos")
    return own.unionByName(padded.select(key, order, value, "grid_return"))


def reject_duplicates(df: DataFrame, keys: Sequence[str]) -> None:
    """Raise if a key combination repeats."""
    if df.groupBy(*keys).count().filter("count > 1").limit(1).count():
        raise ValueError(f"duplicate {tuple(keys)} rows")


def pivot_series(df: DataFrame, keys: Sequence[str], key: str = "ticker", order: str = "date", value: str = "close"):
    """One column per listed key, one row per date; duplicate (date, key) rows are an error."""
    chosen = df.filter(F.col(key).isin(*keys))
    reject_duplicates(chosen, [order, key])
    return chosen.groupBy(order).pivot(key, list(keys)).agg(F.first(value))


WIDTH = 256  # keys of a column block


def correlation(
    df: DataFrame, keys: Sequence[str] | DataFrame | None = None, key: str = "ticker", order: str = "date",
    value: str = "close", pad: bool = False, width: int = WIDTH,
) -> DataFrame:
    """(a, b, corr) of the grid returns of the given keys (a list, a table with a column ``key``, or all) over the dates both
    have; a row for each ordered pair with a common date, NULL when undefined.

    Keys are dealt into blocks of columns. A task gets two blocks of the date x key matrix and computes the moments of all
    their pairs as products of the values, their squares and the marks of what is there; neither keys nor pairs pass through
    the driver, and pairs are rows only in the result.
    """
    if isinstance(keys, DataFrame):
        df = df.join(keys.select(key).distinct(), key, "left_semi")
    elif keys is not None:
        df = df.filter(F.col(key).isin(*keys))
    reject_duplicates(df, [order, key])
    returns = grid_return(df, pad, key, order, value).filter(F.col("grid_return").isNotNull())
    returns = write_and_read(returns.select(F.col(key).alias("_key"), F.col(order).alias("_date"), F.col("grid_return").alias("_r")))
    # Taking off a key's first return keeps the products small, and leaves exact zeros of a constant one.
    first = returns.groupBy("_key").agg(F.min_by("_r", "_date").alias("_base"))
    numbered = write_and_read(ordered_index(first, ["_key"], "_at"))
    day = F.datediff("_date", F.lit("1970-01-01"))
    cells = returns.join(numbered, "_key").select(
        F.floor(F.col("_at") / width).alias("_block"), F.struct((F.col("_at") % width).cast("int").alias("c"), day.alias("d"),
                                                               (F.col("_r") - F.col("_base")).alias("r")).alias("_cell"))
    blocks = write_and_read(cells.groupBy("_block").agg(F.collect_list("_cell").alias("_cells")))  # width x dates at most
    names = write_and_read(numbered.select("_at", "_key"))
    last = blocks.agg(F.max("_block")).scalar()
    partners = blocks.withColumn("_other", F.explode(F.sequence(F.col("_block"), last)))
    pairs = partners.join(blocks.select(F.col("_block").alias("_other"), F.col("_cells").alias("_others")), "_other")

    def table(cells, days: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        values, there = np.zeros((len(days), width)), np.zeros((len(days), width))
        row = np.searchsorted(days, [x["d"] for x in cells])
        column = [x["c"] for x in cells]
        values[row, column], there[row, column] = [x["r"] for x in cells], 1.0
        return values, there

    def moments(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in frames:
            for i, j, mine, other in zip(pdf["_block"], pdf["_other"], pdf["_cells"], pdf["_others"]):
                days = np.unique([x["d"] for x in [*mine, *other]])
                (x, p), (y, q) = table(mine, days), table(other, days)
                n = p.T @ q
                left, right, both = x.T @ q, p.T @ y, x.T @ y
                with np.errstate(divide="ignore", invalid="ignore"):
                    mean_xx, mean_yy = (x * x).T @ q / n, p.T @ (y * y) / n
                    var_x, var_y = mean_xx - (left / n) ** 2, mean_yy - (right / n) ** 2
                    flat = (var_x <= TINY * mean_xx) | (var_y <= TINY * mean_yy)
                    corr = np.where(flat, np.nan, (both / n - left * right / n**2) / np.sqrt(var_x * var_y))
                a, b = np.nonzero(n)
                for s in range(0, len(a), 65_536):
                    u, v = a[s : s + 65_536], b[s : s + 65_536]
                    out = pd.DataFrame({"a": i * width + u, "b": j * width + v, "corr": corr[u, v]})
                    yield out if i == j else pd.concat([out, out.rename(columns={"a": "b", "b": "a"})])

    found = pairs.mapInPandas(moments, "a long, b long, corr double")
    found = found.withColumn("corr", F.when(~F.isnan("corr"), F.col("corr")))
    for side in ("a", "b"):
        found = found.join(names.select(F.col("_at").alias(side), F.col("_key").alias(f"_{side}")), side)
    return found.select(F.col("_a").alias("a"), F.col("_b").alias("b"), "corr")


# --- one ordered series -----------------------------------------------------------------------------------

def row_index(df: DataFrame, order_by: Sequence[str]) -> DataFrame:
    """Contiguous 0-based ``row_index`` along ``order_by``."""
    return ordered_index(df, order_by)


def time_split(indexed: DataFrame, ratio: float = 0.8) -> DataFrame:
    """Mark the first ``int(n * ratio)`` rows ``train`` and the rest ``test``; no shuffle of the rows."""
    cut = indexed.agg(F.floor(F.count("*") * F.lit(float(ratio)))).scalar()
    return indexed.withColumn("side", F.when(F.col("row_index") < cut, "train").otherwise("test"))


def split_side(split: DataFrame, side: str) -> DataFrame:
    """One side, re-indexed from 0. Positions are contiguous, so subtracting the smallest is enough."""
    rows = split.filter(F.col("side") == side)
    return rows.withColumn("row_index", F.col("row_index") - rows.agg(F.min("row_index")).scalar())


def sequences(
    indexed: DataFrame, value: str, lookback: int = LOOKBACK, horizons: Sequence[int] = HORIZONS,
    include_last: bool = False, block: int = 8_192,
) -> DataFrame:
    """(sample, window, label_<h>...): ``lookback`` values and the value ``h`` steps after the window, per sample.

    There are ``n - lookback - max(horizons)`` samples, one fewer than the data allows unless ``include_last``.
    Blocks of consecutive positions are windowed independently; each block also gets the few rows that follow it.
    """
    reach = lookback + max(horizons) - 1
    span = max(block, 2 * reach)
    home = F.floor(F.col("row_index") / span)
    first = F.floor(F.greatest(F.col("row_index") - reach, F.lit(0)) / span)
    blocks = indexed.select("row_index", value, F.explode(F.sequence(first, home)).alias("_block"))
    w = W.partitionBy("_block").orderBy("row_index")
    labels = [F.lead(value, lookback + h - 1).over(w).alias(f"label_{h}") for h in horizons]
    # Wrapped in a struct, because collect_list skips NULLs.
    cells = F.collect_list(F.struct(F.col(value).alias("v"))).over(w.rowsBetween(0, lookback - 1))
    window = F.transform(cells, lambda cell: cell["v"]).alias("window")
    n = indexed.agg(F.count("*")).scalar()
    usable = F.col("sample") < n - lookback - max(horizons) + (1 if include_last else 0)
    rows = blocks.select(F.col("row_index").alias("sample"), "_block", window, *labels)
    return rows.filter((F.floor(F.col("sample") / span) == F.col("_block")) & usable).drop("_block")


def latest_window(indexed: DataFrame, value: str, lookback: int = LOOKBACK) -> DataFrame:
    """The last ``lookback`` rows as (step, row_index, value), step running from ``-lookback + 1`` to 0."""
    n = indexed.agg(F.max("row_index")).scalar()
    step = (F.col("row_index") - n).cast("int")
    tail = indexed.select(step.alias("step"), "row_index", value)
    return tail.filter(F.col("step") > -lookback)


def trajectory(latest: DataFrame, forecast: DataFrame, value: str) -> DataFrame:
    """Known values at steps ``<= 0`` followed by the forecasts at their horizon."""
    known = latest.select("step", F.col(value).alias("value"), F.lit("actual").alias("kind"))
    ahead = forecast.select(F.col("horizon").cast("int").alias("step"), F.col("forecast").alias("value"),
                            F.lit("forecast").alias("kind"))
    return known.unionByName(ahead)
