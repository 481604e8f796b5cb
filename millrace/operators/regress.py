"""Regression models and their evaluation."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce
from multiprocessing.pool import ThreadPool

import numpy as np
import pandas as pd
from pyspark import inheritable_thread_target
from pyspark.ml.functions import array_to_vector
from pyspark.ml.regression import DecisionTreeRegressor, GBTRegressor, LinearRegression, RandomForestRegressor
from pyspark.sql import DataFrame, functions as F

from millrace.operators.features import StandardScale, assemble
from millrace.operators.neighbours import nearest
from millrace.session import cut_lineage, in_pieces

SEED = 42


def linear_fit(df: DataFrame, x: str, y: str) -> DataFrame:
    """(slope, intercept) of one-feature least squares."""
    return df.agg(F.regr_slope(y, x).alias("slope"), F.regr_intercept(y, x).alias("intercept"))


def linear(label: str = "label") -> LinearRegression:
    return LinearRegression(labelCol=label, solver="normal", regParam=0.0)


def tree(label: str = "label", depth: int = 10) -> DecisionTreeRegressor:
    return DecisionTreeRegressor(labelCol=label, maxDepth=depth, seed=SEED)


def forest(label: str = "label", trees: int = 100, depth: int = 10) -> RandomForestRegressor:
    return RandomForestRegressor(labelCol=label, numTrees=trees, maxDepth=depth, seed=SEED)


def boosted(label: str = "label", rounds: int = 100, rate: float = 0.1, depth: int = 6) -> GBTRegressor:
    return GBTRegressor(labelCol=label, maxIter=rounds, stepSize=rate, maxDepth=depth, seed=SEED)


def _fit_predict(estimator, train: DataFrame, test: DataFrame, features, label) -> tuple[DataFrame, object]:
    cols = [*features, label]
    model = estimator.setLabelCol(label).fit(assemble(train.select(*cols), features))
    return model.transform(assemble(test, features)).drop("features"), model


def _grouped(train: DataFrame, features: Sequence[str], label: str) -> DataFrame:
    """Rows of equal features as one, with their mean label and their number ``_n``: a squared loss without draws weighs a split
    the same, and boosting goes through the rows hundreds of times. Spark takes its split candidates from a sample above 10,000
    rows, and ties are broken by rounding, so predictions can differ from those of a fit on single rows. Written once."""
    own = F.xxhash64(*features).alias("_key")
    groups = train.groupBy(*features).agg(F.avg(label).alias(label), F.count("*").cast("double").alias("_n"))
    return in_pieces(cut_lineage(groups.select("*", own)), "_key").sortWithinPartitions(*features)


def boosted_regress(train: DataFrame, test: DataFrame, features: Sequence[str], label: str, **options) -> DataFrame:
    estimator = boosted(label, **options).setWeightCol("_n")
    model = estimator.fit(assemble(_grouped(train, features, label), features))
    return model.transform(assemble(test, features)).drop("features")


def knn_regress(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, k: int = 5
) -> DataFrame:
    """Mean label of the ``k`` nearest training rows (ties by lower key) as ``prediction``."""
    vec = F.array(*[F.col(f).cast("double") for f in features])
    near = nearest(test.select(key, vec.alias("_vec")), train.select(key, vec.alias("_vec")), k, key, key, "_vec")
    labels = train.select(F.col(key).alias("neighbour"), F.col(label).alias("_label"))
    means = near.join(labels, "neighbour").groupBy(key).agg(F.avg("_label").alias("prediction"))
    return test.join(means, key)


def fourier_features(df: DataFrame, features: Sequence[str], gamma: float, size: int = 128) -> DataFrame:
    """Random Fourier features of the RBF kernel (Rahimi & Recht 2007) in ``features``."""
    rng = np.random.default_rng(SEED)
    weights = rng.normal(0.0, np.sqrt(2 * gamma), (len(features), size))
    shift = rng.uniform(0, 2 * np.pi, size)

    @F.pandas_udf("array<double>")
    def lift(x: pd.Series) -> pd.Series:
        return pd.Series(list(np.sqrt(2 / size) * np.cos(np.stack(x.to_numpy()) @ weights + shift)))

    array = F.array(*[F.col(f).cast("double") for f in features])
    return df.withColumn("features", array_to_vector(lift(array)))


def rbf_regress(
    train: DataFrame, test: DataFrame, features: Sequence[str], label: str, c: float = 1.0, gamma: float | None = None
) -> DataFrame:
    """Robust linear fit on random Fourier features. ``gamma`` defaults to 1 / (features x variance)."""
    stats = train.agg(*[F.var_pop(f).alias(f) for f in features], *[F.avg(f).alias(f"m_{f}") for f in features],
                      F.count("*").alias("n")).first()
    if gamma is None:
        means = np.array([stats[f"m_{f}"] for f in features])
        variance = float(np.mean([stats[f] for f in features]) + np.var(means))  # over all entries of the matrix
        gamma = 1.0 / (len(features) * (variance or 1.0))
    fit = LinearRegression(labelCol=label, loss="huber", regParam=1.0 / (c * stats["n"]), maxIter=200)
    model = fit.fit(fourier_features(train, features, gamma))
    return model.transform(fourier_features(test, features, gamma)).drop("features")


# name -> (needs scaled features, fit-and-predict)
MODELS: dict[str, tuple[bool, Callable[..., DataFrame]]] = {
    "linear": (True, lambda tr, te, f, y, key: _fit_predict(linear(), tr, te, f, y)[0]),
    "knn": (True, lambda tr, te, f, y, key, **o: knn_regress(tr, te, f, y, key, **o)),
    "tree": (False, lambda tr, te, f, y, key, **o: _fit_predict(tree(**o), tr, te, f, y)[0]),
    "forest": (False, lambda tr, te, f, y, key, **o: _fit_predict(forest(**o), tr, te, f, y)[0]),
    "rbf": (True, lambda tr, te, f, y, key, **o: rbf_regress(tr, te, f, y, **o)),
    "gbt": (False, lambda tr, te, f, y, key, **o: boosted_regress(tr, te, f, y, **o)),
}


def predict_with(
    name: str, train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str, **options
) -> DataFrame:
    """(key, actual, prediction) of the named model, with its own scaling rule (fitted on ``train``)."""
    scaled, run = MODELS[name]
    if scaled:
        scale = StandardScale.fit(train, features)
        train, test = scale.transform(train), scale.transform(test)
    out = run(train, test, list(features), label, key, **options)
    return out.select(key, F.col(label).alias("actual"), "prediction")


def fit_tree_model(name: str, train: DataFrame, features: Sequence[str], label: str, **options):
    """Fitted tree, forest or boosted model, for its importances or for saving."""
    maker = {"tree": tree, "forest": forest, "gbt": boosted}[name]
    return maker(label, **options).fit(assemble(train.select(*features, label), features))


def feature_importance(spark, model, features: Sequence[str]) -> DataFrame:
    """(feature, importance) ascending; no rows when the model has none."""
    values = getattr(model, "featureImportances", None)
    rows = [] if values is None else [(f, float(v)) for f, v in zip(features, values.toArray())]
    return spark.createDataFrame(rows, "feature string, importance double").orderBy("importance", "feature")


def regression_metrics(df: DataFrame, actual: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """MAE, MSE, RMSE and R2 = 1 - SSE/SST (NULL when the actual values do not vary)."""
    y, e = F.col(actual), F.col(actual) - F.col(predicted)
    grouped = df.groupBy(*by) if by else df.groupBy()
    sums = grouped.agg(
        F.count("*").alias("n"),
        F.avg(F.abs(e)).alias("mae"),
        F.avg(e * e).alias("mse"),
        F.var_pop(y).alias("_var"),
    )
    r2 = F.lit(1.0) - F.try_divide(F.col("mse"), F.col("_var"))
    return sums.withColumn("rmse", F.sqrt("mse")).withColumn("r2", r2).drop("_var")


def compare_models(
    names: Sequence[str], train: DataFrame, test: DataFrame, features: Sequence[str], label: str, key: str,
    options: dict[str, dict] | None = None,
) -> DataFrame:
    """Metrics of several models side by side, best R2 first."""
    train, test = cut_lineage(train), cut_lineage(test)  # read by every model

    def run(n):
        return predict_with(n, train, test, features, label, key, **(options or {}).get(n, {})).withColumn("model", F.lit(n))

    with ThreadPool(min(4, len(names))) as pool:  # independent fits
        frames = pool.map(inheritable_thread_target(train.sparkSession)(run), names)
    union = reduce(DataFrame.unionByName, frames)
    return regression_metrics(union, "actual", "prediction", ["model"]).orderBy(F.desc_nulls_last("r2"), "model")


def identity_line(df: DataFrame, actual: str) -> DataFrame:
    """End points of the perfect-prediction line."""
    return df.agg(F.min(actual).alias("low"), F.max(actual).alias("high"))


def save_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def load_model(kind: type, path: str):
    """``kind`` is the model class, for example ``LinearRegressionModel``."""
    return kind.load(path)
