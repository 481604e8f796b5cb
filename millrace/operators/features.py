"""Feature preparation. Statistics are fitted once (one row reaches the driver) and applied as literals."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.ml.feature import PCA, StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame, functions as F

from millrace.functions import clip
from millrace.operators.ordering import ordered_index
from millrace.operators.quantiles import exact_quantiles


def iqr_bounds(df: DataFrame, column: str, reach: float = 1.5) -> tuple[float | None, float | None]:
    q1, q3 = exact_quantiles(df, [column], [0.25, 0.75])[column]
    if q1 is None:
        return None, None
    return q1 - reach * (q3 - q1), q3 + reach * (q3 - q1)


def iqr_cap(
    df: DataFrame, column: str, lower: float | None = 0.0, reach: float = 1.5, name: str | None = None
) -> DataFrame:
    """Limit to [lower, Q3 + reach * IQR], in place or as a new column."""
    _, upper = iqr_bounds(df, column, reach)
    return df.withColumn(name or column, clip(F.col(column).cast("double"), lower, upper))


def label_codes(df: DataFrame, column: str) -> DataFrame:
    """(value, code): 0-based code by sorted value. Distinct values are numbered without a global window."""
    return ordered_index(df.select(column).filter(F.col(column).isNotNull()).distinct(), [column], f"{column}_code")


def label_encode(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Add ``<column>_code`` for every column."""
    for c in columns:
        df = df.join(label_codes(df, c), c, "left")
    return df


def hash_split(df: DataFrame, key: str, test_fraction: float = 0.2, seed: int = 42) -> DataFrame:
    """Mark rows ``train`` or ``test`` from a hash of key and seed. The same row always lands on the same side,
    whatever the partitioning; the fraction is met approximately (in steps of 1/65536)."""
    digest = F.substring(F.md5(F.concat_ws(":", F.col(key).cast("string"), F.lit(str(seed)))), 1, 4)
    below = F.conv(digest, 16, 10).cast("int") < round(test_fraction * 65536)
    return df.withColumn("side", F.when(below, "test").otherwise("train"))


@dataclass(frozen=True)
class StandardScale:
    """Zero mean, unit population deviation; a constant column keeps deviation 1."""

    stats: dict[str, tuple[float, float]]

    @classmethod
    def fit(cls, df: DataFrame, columns: Sequence[str]) -> StandardScale:
        row = df.agg(*[f(c).alias(f"{n}_{c}") for c in columns for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
        return cls({c: (row[f"m_{c}"] or 0.0, row[f"s_{c}"] or 1.0) for c in columns})

    def transform(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: (F.col(c) - F.lit(m)) / F.lit(s) for c, (m, s) in self.stats.items()})


@dataclass(frozen=True)
class MinMaxScale:
    """Linear map of the fitted range to [0, 1]; other data may fall outside."""

    low: float
    high: float

    @classmethod
    def fit(cls, df: DataFrame, column: str) -> MinMaxScale:
        row = df.agg(F.min(column).cast("double").alias("a"), F.max(column).cast("double").alias("b")).first()
        return cls(row["a"], row["b"])

    @property
    def span(self) -> float:
        return (self.high - self.low) or 1.0

    def scaled(self, c):
        return (c - F.lit(self.low)) / F.lit(self.span)

    def inverse(self, c):
        return c * F.lit(self.span) + F.lit(self.low)


def assemble(df: DataFrame, features: Sequence[str], name: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(features), outputCol=name).transform(df)


@dataclass(frozen=True)
class Projection:
    """Principal axes: ``loadings[j]`` is component j."""

    features: tuple[str, ...]
    mean: tuple[float, ...]
    loadings: np.ndarray
    ratios: tuple[float, ...]

    def transform(self, df: DataFrame, prefix: str = "pc") -> DataFrame:
        """Centred scores as plain columns."""
        scores = {}
        for j, axis in enumerate(self.loadings):
            terms = [(F.col(f) - F.lit(m)) * F.lit(float(w)) for f, m, w in zip(self.features, self.mean, axis)]
            scores[f"{prefix}{j + 1}"] = sum(terms[1:], terms[0])
        return df.withColumns(scores)


def pca(df: DataFrame, features: Sequence[str], variance: float | None = 0.95, k: int | None = None) -> Projection:
    """The fewest components whose variance ratios add up to more than ``variance``, or exactly ``k``.

    The covariance is summed on the executors and is features x features. Signs are fixed by making the largest
    loading of each component positive.
    """
    features = tuple(features)
    vectors = assemble(df.select(*features), features, "_raw")
    centre = StandardScaler(withMean=True, withStd=False, inputCol="_raw", outputCol="_centred").fit(vectors)
    model = PCA(k=len(features), inputCol="_centred", outputCol="_scores").fit(centre.transform(vectors))
    axes = model.pc.toArray().T
    signs = np.sign(axes[np.arange(len(axes)), np.abs(axes).argmax(axis=1)])
    axes = axes * np.where(signs == 0, 1.0, signs)[:, None]
    ratios = model.explainedVariance.toArray()
    if k is None:
        k = int(np.searchsorted(np.cumsum(ratios), variance, side="right")) + 1
    k = min(k, len(features))
    return Projection(features, tuple(centre.mean.toArray()), axes[:k], tuple(float(r) for r in ratios[:k]))


def variance_table(spark, projection: Projection) -> DataFrame:
    """(component, ratio, cumulative)."""
    total = np.cumsum(projection.ratios)
    rows = [(j + 1, float(r), float(c)) for j, (r, c) in enumerate(zip(projection.ratios, total))]
    return spark.createDataFrame(rows, "component int, ratio double, cumulative double")


def spread_vector(df: DataFrame, column: str, size: int, prefix: str = "f") -> DataFrame:
    """Array (or ML vector) column -> one double column per position."""
    array = F.col(column) if df.schema[column].dataType.typeName() == "array" else vector_to_array(column)
    return df.withColumns({f"{prefix}{i + 1}": array[i].cast("double") for i in range(size)})
