"""Optional, composable filters."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

# Price tiers.
BUDGET_BELOW = 300
PREMIUM_ABOVE = 800


def price_tier(cost: str = "cost") -> Column:
    """Budget / Mid-Range / Premium; both limits belong to the middle tier; NULL cost has no tier."""
    c = F.col(cost)
    return (
        F.when(c < BUDGET_BELOW, "Budget").when(c > PREMIUM_ABOVE, "Premium").when(c.isNotNull(), "Mid-Range")
    )


def tier_predicate(tier: str, cost: str = "cost") -> Column:
    """A plain range test per tier, so it is pushed to the source."""
    c = F.col(cost)
    ranges = {
        "Budget": c < BUDGET_BELOW,
        "Mid-Range": c.between(BUDGET_BELOW, PREMIUM_ABOVE),
        "Premium": c > PREMIUM_ABOVE,
    }
    return ranges[tier]


def apply_filters(
    df: DataFrame,
    locations: Sequence[str] | None = None,
    min_rating: float = 0,
    tier: str | None = None,
    online: bool = False,
    booking: bool = False,
    columns: Sequence[str] | None = None,
) -> DataFrame:
    """Rows that pass every option in use. ``"All"`` among the locations or as the tier switches that test off,
    as does a rating of 0; the flags only ever ask for ``Yes``."""
    tests: list[Column] = []
    if locations and "All" not in locations:
        tests.append(F.col("location").isin(*locations))
    if min_rating > 0:
        tests.append(F.col("rate") >= min_rating)
    if tier and tier != "All":
        tests.append(tier_predicate(tier))
    if online:
        tests.append(F.col("online_order") == "Yes")
    if booking:
        tests.append(F.col("book_table") == "Yes")
    out = df.filter(reduce(lambda a, b: a & b, tests)) if tests else df
    return out.select(*columns) if columns else out


def in_keys(df: DataFrame, keys: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in ``keys``."""
    return df.join(keys, on, "left_semi")
