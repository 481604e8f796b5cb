"""Distribution building blocks, with limits small enough that the large-input paths run."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from millrace.operators import blocks, ordering, quantiles


@pytest.fixture(scope="module")
def ticks(spark):
    """One key holds most rows; some values are missing."""
    rng = np.random.default_rng(7)
    pdf = pd.DataFrame({"key": np.where(rng.random(900) < 0.6, "hot", rng.integers(0, 9, 900).astype(str)),
                        "t": rng.permutation(900), "v": rng.normal(size=900).round(3)})
    pdf["v"] = pdf["v"].where(rng.random(900) > 0.2)
    return spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "key string, t int, v double").repartition(7)


def rows(df, *columns):
    return sorted(tuple((v is None, v) for v in r) for r in df.select(*columns).collect())


def test_ordered_index_is_contiguous_with_ties(spark):
    df = spark.range(1000).select((F.col("id") % 3).alias("g"), "id").repartition(11)
    got = ordering.ordered_index(df, ["g", "id"]).orderBy("row_index").collect()
    assert [r["row_index"] for r in got] == list(range(1000))
    assert [(r["g"], r["id"]) for r in got] == sorted((i % 3, i) for i in range(1000))


def by_key(pdf, keys, f):
    """A pandas column computed along t, per key (rows without a key being a key of their own) or over all rows."""
    pdf = pdf.sort_values("t")
    return sorted((t, None if v != v else v) for t, v in zip(pdf["t"], f(pdf.groupby("key", dropna=False)["v"] if keys else pdf["v"])))


@pytest.mark.parametrize("keys", [["key"], []])
@pytest.mark.parametrize("parts", [1, 3, 13])
def test_scans_equal_pandas(spark, ticks, keys, parts):
    """A key with most rows, keys without values at a partition's edge, rows without a key; few and many partitions."""
    pdf = ticks.toPandas()
    pdf.loc[pdf.index[:40], "key"] = None
    pdf.loc[(pdf["t"] > 300) & (pdf["t"] < 700), "v"] = np.nan
    df = spark.createDataFrame(pdf.astype(object).where(pdf.notna(), None), "key string, t int, v double").repartition(4)
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        previous = ordering.with_previous(df, keys, "t", "v", "p")
        assert sorted((r.t, r.p) for r in previous.collect()) == by_key(pdf, keys, lambda g: g.shift())
        assert previous.columns == ["key", "t", "v", "p"]
        filled = ordering.forward_fill(df, "v", "t", keys)
        assert sorted((r.t, r.v) for r in filled.collect()) == by_key(pdf, keys, lambda g: g.ffill())
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "8")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


def test_scan_cuts_a_key_that_holds_all_rows(spark):
    """One key, twenty thousand rows: no partition holds much more than its share."""
    df = spark.range(20_000).select(F.lit("one").alias("key"), F.xxhash64("id").alias("t"), F.col("id").cast("double").alias("v"))
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        placed = ordering._in_order(df, ["key"], "t")
        shares = [r["count"] for r in placed.groupBy("_pid").count().collect()]
    finally:
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert len(shares) == 8 and max(shares) < 2 * 20_000 / 8
    previous = ordering.with_previous(df, ["key"], "t", "v", "p")
    assert previous.filter("p is null").count() == 1


@pytest.mark.parametrize("kind", ["normal", "ties", "two_values", "tiny"])
def test_exact_quantiles_narrowing(spark, kind):
    rng = np.random.default_rng(3)
    x = {"normal": rng.normal(size=20_000), "ties": rng.integers(0, 5, 20_000).astype(float),
         "two_values": np.where(rng.random(20_000) < 0.5, 1.0, 1.0000001), "tiny": np.array([1.0, 4.0, 2.0])}[kind]
    df = spark.createDataFrame(pd.DataFrame({"x": x})).repartition(5)
    probabilities = [0.0, 0.013, 0.25, 0.5, 0.75, 0.999, 1.0]
    got = quantiles.exact_quantiles(df, ["x"], probabilities, gather=50)["x"]
    assert np.allclose(got, np.quantile(x, probabilities), rtol=0, atol=1e-12)


def test_exact_quantiles_without_values(spark):
    df = spark.createDataFrame([(None,)], "x double")
    assert quantiles.exact_quantiles(df, ["x"], [0.5])["x"] == [None]


def test_pair_blocks_keeps_the_join(spark):
    left = spark.range(300).select(F.when(F.col("id") < 150, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("l"))
    right = spark.range(200).select(F.when(F.col("id") < 90, 0).otherwise(F.col("id") % 40).alias("k"), F.col("id").alias("r"))
    want = sorted(left.join(right, "k").select("l", "r").collect())
    a, b = blocks.pair_blocks(left, right, ["k"], "l", "r", block=16)
    joined = a.join(b, ["k", "_lb", "_rb"])
    assert sorted(joined.select("l", "r").collect()) == want
    assert a.groupBy("k", "_lb", "_rb").count().agg(F.max("count")).first()[0] < 50


def test_salted_lookup_keeps_the_join(spark):
    df = spark.range(500).select(F.when(F.col("id") < 300, 0).otherwise(F.col("id") % 20).alias("k"), "id")
    table = df.groupBy("k").agg(F.count("*").alias("n"), (F.sum("id") % 97).alias("x"))
    want = sorted(df.join(table, "k").select("id", "x").collect())
    got = blocks.salted_lookup(df, table, "k", "n", "id", hot_rows=10, hot_share=50)
    assert sorted(got.select("id", "x").collect()) == want
