"""Direct multi-horizon forecasting on lookback windows: one model per horizon, one shared contract."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from functools import reduce
from multiprocessing.pool import ThreadPool

from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from millrace.operators.features import MinMaxScale
from millrace.operators.regress import SEED
from millrace.operators.series import HORIZONS, LOOKBACK, latest_window, sequences, split_side
from millrace.session import in_pieces

HOLDOUT = 0.1
EPSILON = 2.220446049250313e-16  # double precision machine epsilon

KINDS = {
    "linear": lambda: LinearRegression(solver="normal", regParam=0.0),
    "forest": lambda: RandomForestRegressor(numTrees=100, maxDepth=5, seed=SEED),
    "gbt": lambda: GBTRegressor(maxIter=30, stepSize=0.1, maxDepth=3, seed=SEED),
}


@dataclass(frozen=True)
class Prepared:
    """Scaled sequences of both sides and the scale fitted on the training side."""

    train: DataFrame
    test: DataFrame
    scale: MinMaxScale


def prepare(
    split: DataFrame, value: str, lookback: int = LOOKBACK, horizons: Sequence[int] = HORIZONS
) -> Prepared:
    """Split series -> scaled sequences. Windows never cross the split and the scale only sees the training side."""
    scale = MinMaxScale.fit(split.filter(F.col("side") == "train"), value)
    sides = {}
    for side in ("train", "test"):
        rows = split_side(split, side).select("row_index", scale.scaled(F.col(value)).alias("x"))
        sides[side] = sequences(rows, "x", lookback, horizons)
    return Prepared(sides["train"], sides["test"], scale)


@contextmanager
def _fit_rows(train: DataFrame) -> Iterator[DataFrame]:
    """The samples as the fits read them, cached: in as few pieces as their number asks for, in order, so that a fit of many small
    rounds does not start a task for every shuffle partition in each."""
    found = train.withColumn("features", array_to_vector("window")).persist()
    rows = in_pieces(found, "sample").sortWithinPartitions("sample").persist()
    try:
        rows.count()
        found.unpersist()
        yield rows
    finally:
        found.unpersist()
        rows.unpersist()


def fit_kinds(train: DataFrame, kinds: Sequence[str], horizons: Sequence[int] = HORIZONS) -> dict[str, dict]:
    """One fitted model per kind and horizon, from all samples; none for persistence."""
    wanted = [(kind, h) for kind in kinds if kind != "persistence" for h in horizons]
    fitted = {kind: {} for kind in kinds}
    if not wanted:
        return fitted

    with _fit_rows(train) as rows, ThreadPool(len(wanted)) as pool:  # independent fits over the same cached rows
        def run(job):
            return KINDS[job[0]]().setLabelCol(f"label_{job[1]}").fit(rows)

        for (kind, h), model in zip(wanted, pool.map(inheritable_thread_target(train.sparkSession)(run), wanted)):
            fitted[kind][h] = model
    return fitted


def fit_horizons(train: DataFrame, kind: str, horizons: Sequence[int] = HORIZONS) -> Mapping:
    """One fitted model per horizon, from all samples."""
    return fit_kinds(train, [kind], horizons)[kind]


def predict_horizons(
    windows: DataFrame, models: Mapping, scale: MinMaxScale | None = None, horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """(sample, horizon, forecast[, actual]) in the original unit. Without models the last value persists."""
    has_labels = all(f"label_{h}" in windows.columns for h in horizons)
    rows = windows.withColumn("features", array_to_vector("window")) if models else windows
    for h in horizons:
        if models:
            rows = models[h].setPredictionCol(f"_p{h}").transform(rows)
        else:
            rows = rows.withColumn(f"_p{h}", F.element_at("window", -1))
    back = scale.inverse if scale else (lambda c: c)
    cells = [
        F.struct(
            F.lit(h).alias("horizon"),
            back(F.col(f"_p{h}")).alias("forecast"),
            *([back(F.col(f"label_{h}")).alias("actual")] if has_labels else []),
        )
        for h in horizons
    ]
    return rows.select("sample", F.inline(F.array(*cells)))


def holdout_metrics(
    prepared: Prepared, kinds: Sequence[str], horizons: Sequence[int] = HORIZONS, holdout: float = HOLDOUT
) -> DataFrame:
    """Errors of each kind on the last ``holdout`` share of the training samples, fitted on those before."""
    n = prepared.train.agg(F.count("*")).scalar()
    early = F.col("sample") < F.floor(n * F.lit(1 - holdout))
    parts = Prepared(prepared.train.filter(early), prepared.train.filter(~early), prepared.scale)
    return horizon_metrics(run_kinds(parts, kinds, horizons), ["model"])


def forecast(
    train: DataFrame, test: DataFrame, kind: str, scale: MinMaxScale | None = None,
    horizons: Sequence[int] = HORIZONS,
) -> DataFrame:
    """Fit ``kind`` (persistence, linear, forest, gbt) on ``train`` sequences and forecast ``test`` sequences."""
    return predict_horizons(test, fit_horizons(train, kind, horizons), scale, horizons)


def horizon_metrics(forecasts: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MAE, RMSE and two MAPE forms per horizon: ``mape`` skips zero actual values, ``mape_eps`` adds the machine
    epsilon to the denominator."""
    e = F.col("actual") - F.col("forecast")
    return forecasts.groupBy(*by, "horizon").agg(
        F.avg(F.abs(e)).alias("mae"),
        F.sqrt(F.avg(e * e)).alias("rmse"),
        (F.avg(F.abs(F.try_divide(e, F.col("actual")))) * 100).alias("mape"),
        (F.avg(F.abs(F.try_divide(e, F.col("actual") + F.lit(EPSILON)))) * 100).alias("mape_eps"),
    )


def run_kinds(prepared: Prepared, kinds: Sequence[str], horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """Test forecasts of several kinds with a ``model`` column."""
    fitted = fit_kinds(prepared.train, kinds, horizons)
    frames = [
        predict_horizons(prepared.test, fitted[kind], prepared.scale, horizons).withColumn("model", F.lit(kind))
        for kind in kinds
    ]
    return reduce(DataFrame.unionByName, frames)


def forecast_comparison(forecasts: DataFrame, horizons: Sequence[int] = HORIZONS) -> DataFrame:
    """MAE per model and horizon with the overall MAE, best first, rounded to 2 places."""
    error = F.abs(F.col("actual") - F.col("forecast"))
    columns = [F.round(F.avg(F.when(F.col("horizon") == h, error)), 2).alias(f"mae_{h}") for h in horizons]
    table = forecasts.groupBy("model").agg(*columns, F.round(F.avg(error), 2).alias("mae_overall"))
    return table.orderBy("mae_overall", "model")


def last_window(indexed: DataFrame, value: str, scale: MinMaxScale, lookback: int = LOOKBACK) -> DataFrame:
    """The most recent ``lookback`` rows as one scaled window."""
    rows = latest_window(indexed, value, lookback)
    cell = F.struct("step", scale.scaled(F.col(value)).alias("x"))
    ordered = F.transform(F.array_sort(F.collect_list(cell)), lambda c: c["x"])  # lookback rows
    return rows.agg(ordered.alias("window"), F.max("row_index").alias("sample"))


def last_sample(sequences_: DataFrame) -> DataFrame:
    """The last sample that still has its labels."""
    return sequences_.orderBy(F.desc("sample")).limit(1)


def forecast_latest(
    prepared: Prepared, window: DataFrame, kinds: Sequence[str], horizons: Sequence[int] = HORIZONS
) -> DataFrame:
    """(horizon, one rounded column per kind) for one window."""
    window = window.select("sample", "window")
    fitted = fit_kinds(prepared.train, kinds, horizons)
    frames = []
    for kind in kinds:
        out = predict_horizons(window, fitted[kind], prepared.scale, horizons)
        frames.append(out.select("horizon", F.lit(kind).alias("model"), F.round("forecast", 2).alias("forecast")))
    stacked = reduce(DataFrame.unionByName, frames)
    return stacked.groupBy("horizon").pivot("model", list(kinds)).agg(F.first("forecast")).orderBy("horizon")
