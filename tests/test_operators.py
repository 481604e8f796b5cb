"""Hand cases."""

import dataclasses
import json
import random
from decimal import Decimal

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F, types as T

from millrace import functions as fn, sources
from millrace.operators import clean, docs, features, filters, forecast, ordering, profile, regress, rollups, series, text
from millrace.session import write_and_read
from millrace.sources import files


def column(df, name="x"):
    return [r[name] for r in df.collect()]


def frame(spark, values, kind="string"):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"id int, v {kind}").coalesce(1)


@pytest.mark.parametrize("parse,given,want", [
    (fn.parse_rating, ["4.1/5", "NEW", "-", "nan", None, "inf", "4.1d", " 3 /5", "5"], [4.1, None, None, None, None, None, None, 3.0, 5.0]),
    (fn.parse_number, ["1,200", "12,345.6", "", "x", None, "1e3"], [1200.0, 12345.6, None, None, None, 1000.0]),
    (fn.parse_magnitude, ["1.2K", " 3.4m ", "5B", "-", None, "17", "junk", "K"], [1200.0, 3.4e6, 5e9, None, None, 17.0, None, None]),
    (fn.yes_flag, ["Yes", "No", None, "yes"], [1, 0, 0, 0]),
    (fn.add_suffix, ["ABC", "ABC.NS", None], ["ABC.NS", "ABC.NS", None]),
    (fn.lookup_key, ["  The Film\t", "X", None], ["the film", "x", None]),
])
def test_parsing(spark, parse, given, want):
    assert column(frame(spark, given).select(parse("v").alias("x"))) == want


def test_dates_nan_clip_label(spark):
    got = column(frame(spark, ["01-02-2020", "1-2-2020", "31-02-2020", "x", None]).select(fn.parse_date("v").cast("string").alias("x")))
    assert got == ["2020-02-01", "2020-02-01", None, None, None]
    numbers = frame(spark, [float("nan"), None, -3.0, 9.0], "double")
    assert column(numbers.select(fn.drop_nan("v").alias("x"))) == [None, None, -3.0, 9.0]
    assert column(numbers.filter("id > 0").select(fn.clip("v", 0.0, 5.0).alias("x"))) == [None, 0.0, 5.0]
    assert column(frame(spark, [0.873, 1.0], "double").select(fn.percent_label("v").alias("x"))) == ["87.3%", "100.0%"]
    assert column(frame(spark, [0.0, 2.0], "double").select(fn.ratio_change(F.lit(3.0), "v").alias("x"))) == [None, 0.5]


def test_headers_and_projection(spark):
    df = spark.createDataFrame([(1, 2)], ["  trade DATE ", "close"])
    assert clean.tidy_headers(df).columns == ["Trade date", "Close"]
    assert clean.rename_columns(df, {"close": "price"}).columns == ["  trade DATE ", "price"]
    assert clean.keep_columns(df, ["close", "volume"]).columns == ["close"]
    assert clean.drop_columns(df, ["close", "volume"]).columns == ["  trade DATE "]


def test_profile(spark):
    df = spark.createDataFrame([(1, None), (2, "a"), (3, None)], "k int, v string")
    assert {tuple(r) for r in profile.null_counts(df).collect()} == {("k", 0), ("v", 2)}
    assert {tuple(r) for r in profile.row_null_counts(df, "k").collect()} == {(1, 1), (3, 1)}
    assert [tuple(r) for r in profile.table_schema(df).collect()] == [("k", "int"), ("v", "string")]
    assert profile.count_outside(df, "k", 2, 2).first()[0] == 2
    one = profile.describe(spark.createDataFrame([(5.0,)], "x double"), ["x"]).first()
    assert one["std"] is None and one["p50"] == 5.0


def test_fills_and_dedupe(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "b", 4.0), (4, None, None)], "i int, k string, v double")
    assert sorted(column(clean.fill_mean(df, "v"), "v")) == [1.0, 2.5, 2.5, 4.0]
    assert sorted(column(clean.fill_median(df, "v"), "v")) == [1.0, 2.5, 2.5, 4.0]
    assert clean.fill_median(df, "v", approximate=True).filter("v is null").count() == 0
    assert [r["k"] for r in clean.fill_constant(df, "").orderBy("i").collect()] == ["a", "a", "b", ""]
    assert sorted(r["i"] for r in clean.dedupe_first(df, ["k"], ["i"]).collect()) == [1, 3, 4]
    assert [tuple(r) for r in clean.duplicate_keys(df, ["k"]).collect()] == [("a", 2)]


def test_filters_are_pushed_down(spark, tmp_path):
    rows = [("A", 4.1, 300.0, "Yes", "No"), ("B", 4.1, 800.0, "Yes", "Yes"), ("C", 2.0, 801.0, "No", "Yes"), ("A", None, 299.0, "No", "No")]
    spark.createDataFrame(rows, "location string, rate double, cost double, online_order string, book_table string").write.parquet(str(tmp_path / "t"))
    df = spark.read.parquet(str(tmp_path / "t"))
    assert filters.apply_filters(df, ["All", "A"]).count() == 4
    assert filters.apply_filters(df, ["A", "B"], min_rating=4.1).count() == 2
    assert [filters.apply_filters(df, tier=t).count() for t in ("Budget", "Mid-Range", "Premium", "All")] == [1, 2, 1, 4]
    assert filters.apply_filters(df, online=True, booking=True).count() == 1
    plan = filters.apply_filters(df, ["A"], 4.0, "Premium", columns=["location", "rate"])._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(location), IsNotNull(rate), IsNotNull(cost), EqualTo(location,A)" in plan
    assert df.select(filters.price_tier().alias("t")).distinct().count() == 3


def test_bins_keep_empty_and_edges(spark):
    df = spark.createDataFrame([(0.0, 1.0), (249.9, 2.0), (250.0, 3.0), (2000.0, 4.0), (-1.0, 9.0), (None, 9.0)], "x double, v double")
    got = {r["bin"]: r["average"] for r in rollups.bin_mean(df, "x", "v").collect()}
    assert got == {"<250": 1.5, "250-500": 3.0, ">2000": 4.0, "500-750": None, "750-1000": None, "1000-1500": None, "1500-2000": None}


def test_ties_at_the_limit(spark):
    df = spark.createDataFrame([(k, 1.0, "n") for k in "cab"] + [("z", 0.5, None)], "k string, v double, n string")
    assert column(rollups.top_mean(df, "k", "v", 2), "k") == ["a", "b"]
    assert rollups.count_by(df, "k", "n").filter("k = 'z'").first()["n"] == 0
    money = spark.createDataFrame([("a", Decimal("1.10")), ("a", Decimal("2.20"))], "k string, v decimal(10,2)")
    assert rollups.sum_by(money, "k", "v").first()["total"] == Decimal("3.30")


PRICES = [("A", "2024-01-01", 10.0), ("A", "2024-01-02", 12.0), ("A", "2024-01-04", 6.0), ("B", "2024-01-01", 5.0),
          ("B", "2024-01-03", 10.0), ("C", "2024-01-02", 0.0), ("C", "2024-01-04", 3.0), (None, "2024-01-01", 1.0)]


@pytest.fixture(scope="module")
def prices(spark):
    return spark.createDataFrame(PRICES, "ticker string, date string, close double").withColumn("date", F.to_date("date"))


def test_returns(prices):
    got = {(r["ticker"], str(r["date"])[-2:]): r["daily_return"] for r in series.pct_change(prices).collect()}
    assert got[("A", "01")] is None and got[("A", "04")] == -0.5 and got[("C", "04")] is None and len(got) == 7
    grid = {(r["ticker"], str(r["date"])[-2:]): r["grid_return"] for r in series.grid_return(prices).collect()}
    assert grid[("A", "02")] == pytest.approx(0.2) and grid[("A", "04")] is None and grid[("B", "03")] is None
    pad = {(r["ticker"], str(r["date"])[-2:]): (r["close"], r["grid_return"]) for r in series.grid_return(prices, pad=True).collect()}
    assert pad[("A", "03")] == (12.0, 0.0) and pad[("A", "04")] == (6.0, -0.5) and pad[("B", "04")] == (10.0, 0.0)
    assert pad[("B", "03")] == (10.0, 1.0) and len(pad) == 4 + 4 + 3
    assert {r["ticker"] for r in series.total_return(prices).collect()} == {"A", "B", "C"}


def test_one_row_key_has_no_volatility(spark):
    df = spark.createDataFrame([("A", 1, 2.0), ("B", 1, 1.0), ("B", 2, 2.0), ("B", 3, 3.0)], "ticker string, date int, close double")
    assert column(series.volatility(series.pct_change(df)), "ticker") == ["B"]


def test_correlation_undefined_and_pivot_duplicates(spark, prices):
    flat = spark.createDataFrame([(t, d, 2.0 if t == "F" else float(d * d)) for t in "FG" for d in range(1, 6)],
                                 "ticker string, date int, close double").withColumn("date", F.date_add(F.lit("2024-01-01").cast("date"), F.col("date")))
    got = {(r["a"], r["b"]): r["corr"] for r in series.correlation(flat, ["F", "G"]).collect()}
    assert got[("F", "G")] is None and got[("G", "G")] == pytest.approx(1.0) and len(got) == 4
    wide = series.pivot_series(prices, ["A", "B"])
    assert wide.columns == ["date", "A", "B"] and wide.count() == 4
    with pytest.raises(ValueError):
        series.pivot_series(prices.union(prices.limit(1)), ["A"])


def test_gainers_losers_overlap(spark):
    df = spark.createDataFrame([("2024-01", t, float(i)) for i, t in enumerate("abcdefg")], "month string, ticker string, `return` double")
    out = series.gainers_losers(df)
    assert out.filter("side = 'gainer'").count() == 5 and out.filter("side = 'loser'").count() == 5
    assert out.groupBy("ticker").count().filter("count = 2").count() == 3


def test_sector_rollup(spark):
    df = spark.createDataFrame([("b", 1.0), ("a", 3.0), ("x", 9.0)], "ticker string, `return` double")
    dim = spark.createDataFrame([("a", "T"), ("b", "T")], "ticker string, sector string")
    got = [tuple(r) for r in series.sector_rollup(series.join_sector(df, dim)).collect()]
    assert got == [("Other", 9.0, "x"), ("T", 2.0, "a, b")]


@pytest.mark.parametrize("n,samples,last", [(66, 0, 0), (67, 0, 1), (68, 1, 2), (100, 33, 34)])
def test_sequence_count(spark, n, samples, last):
    df = spark.range(n).select(F.col("id").alias("row_index"), (F.col("id") * 1.0).alias("v"))
    got = series.sequences(df, "v").orderBy("sample").collect()
    assert len(got) == samples and series.sequences(df, "v", include_last=True).count() == last
    for r in got:
        i = r["sample"]
        assert r["window"] == [float(j) for j in range(i, i + 60)]
        assert (r["label_1"], r["label_3"], r["label_7"]) == (i + 60, i + 62, i + 66)


def test_sequences_across_blocks_keep_nulls(spark):
    df = spark.range(200).select(F.col("id").alias("row_index"), F.when(F.col("id") != 50, F.col("id") * 1.0).alias("v"))
    small = series.sequences(df, "v", lookback=5, horizons=(1, 2), block=10).orderBy("sample").collect()
    assert [r["sample"] for r in small] == list(range(193))
    assert small[48]["window"] == [48.0, 49.0, None, 51.0, 52.0] and small[48]["label_2"] == 54.0


def test_split_and_latest(spark):
    df = series.row_index(spark.range(11).select((F.col("id") * 3).alias("t")), ["t"])
    split = series.time_split(df)
    assert {r["side"]: r["count"] for r in split.groupBy("side").count().collect()} == {"train": 8, "test": 3}
    assert sorted(column(series.split_side(split, "test"), "row_index")) == [0, 1, 2]
    assert sorted(column(series.latest_window(df, "t", 3), "step")) == [-2, -1, 0]


def test_mape_skips_zero(spark):
    df = spark.createDataFrame([(1, 0.0, 1.0), (1, 2.0, 1.0)], "horizon int, actual double, forecast double")
    row = forecast.horizon_metrics(df).first()
    assert row["mae"] == 1.0 and row["mape"] == 50.0 and row["mape_eps"] > 1e15


# --- text and documents -----------------------------------------------------------------------------------

def test_text_cleaning(spark):
    df = frame(spark, ["  The DOGS ran, (well-known) boxes' churches... ", "", None, " \n "])
    assert column(df.select(text.normalize_text("v").alias("x"))) == ["the dogs ran, (well-known) boxes' churches...", "", "", ""]
    assert column(df.select(text.clean_story("v").alias("x"))) == ["dog ran well-known box church", "", "", ""]
    lemmas = spark.createDataFrame([("ran", "run")], "word string, lemma string")
    words = df.select("id", text.remove_stop_words(text.tokens(text.normalize_text("v"))).alias("w"))
    got = {r["id"]: r["w"] for r in text.lemmatize_with(words, "id", "w", lemmas).collect()}
    assert got == {0: ["dog", "run", "well-known", "box", "church"], 1: [], 2: [], 3: []}


def test_fits_read_few_pieces_in_order(spark, monkeypatch):
    """The fits of a short series do not get a piece for every shuffle partition, and kinds share the rows."""
    seen = []

    class Probe:
        def setLabelCol(self, name):
            self.name = name
            return self

        def fit(self, rows):
            seen.append((self.name, rows.rdd.getNumPartitions(), [r["sample"] for r in rows.select("sample").collect()]))
            return self.name

    monkeypatch.setitem(forecast.KINDS, "probe", Probe)
    indexed = spark.range(400).select(F.col("id").alias("row_index"), (F.col("id") % 7).cast("double").alias("x"))
    train = series.sequences(indexed.repartition(8), "x")
    assert forecast.fit_horizons(train, "probe") == {h: f"label_{h}" for h in forecast.HORIZONS}
    assert sorted(seen) == [(f"label_{h}", 1, list(range(400 - 67))) for h in forecast.HORIZONS]
    assert forecast.fit_kinds(train, ["persistence"]) == {"persistence": {}}


@pytest.fixture(scope="module")
def corpus(spark):
    texts = ["red fox jumps", "red fox jumps", "blue whale sings", "red whale", "", "fox fox fox"]
    return spark.createDataFrame(list(enumerate(texts)), "id int, t string")


def test_similar_docs_excludes_self_and_pads(spark, corpus):
    seeds = spark.createDataFrame([(0,), (4,)], "id int")
    got = {}
    for r in text.similar_docs(corpus, seeds, "id", "t", 4).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["id"], round(r["score"], 6)))
    assert got[0][0] == (1, 1.0) and [i for i, _ in got[0]] == [1, 5, 3, 2] and got[0][3][1] == 0.0
    assert got[4] == [(0, 0.0), (1, 0.0), (2, 0.0), (3, 0.0)]


def test_searches_weigh_only_the_terms_asked_for(spark, corpus):
    model = text.TfIdf.fit(corpus, "id", "t")
    q = corpus.limit(1).select(F.lit("q").alias("q"), F.col("t").alias("s"))
    text.match_text(corpus, q, "id", "t", "q", "s", 2, model).collect()
    text.similar_docs(corpus, corpus.limit(1), "id", "t", 2, model).collect()
    assert "_weights" not in model.__dict__  # the weights of all postings were never made
    every = {(r["id"], r["term"]): r["weight"] for r in model.weights().collect()}
    term = min(t for _, t in every)
    some = {(r["id"], r["term"]): r["weight"] for r in model.weights_of(model.terms.filter(F.col("term") == term)).collect()}
    assert some == pytest.approx({k: w for k, w in every.items() if k[1] == term})


def test_searches_join_words_of_blocks_not_postings(spark):
    """Blocks of documents give the same vectors and the same best documents whatever their size, and postings are not shuffled."""
    draw = random.Random(9)
    words = [f"w{i}" for i in range(30)] + ["Ünïcode", "中文字", "x_1", "22", "a", "İz"]
    rows = [(i, " ".join(draw.choices(words, k=9))) for i in range(60)] + [(60, ""), (61, None), (62, "a b"), (63, "yy\x00zz\n\tyy")]
    df = spark.createDataFrame(rows, "id int, t string")
    whole = text.TfIdf.fit(df, "id", "t")
    model = dataclasses.replace(whole, blocks=write_and_read(text.packed_terms(df, "id", "t", most=200)))
    assert model.blocks.count() > 5
    weighted = model.weighted()
    assert sorted((r.id, r.term, r.tf) for r in weighted.collect()) == sorted(tuple(r) for r in text.postings(df, "id", "t").collect())
    assert "Window" not in weighted._jdf.queryExecution().executedPlan().toString()
    vectors = {}
    for r in whole.weights().collect():
        vectors.setdefault(r.id, {})[r.term] = r.weight
    seeds = df.filter("id % 20 = 3")
    got = {}
    for r in text.similar_docs(df, seeds, "id", "t", 5, model).orderBy("query_id", "rank").collect():
        got.setdefault(r.query_id, []).append((r.id, round(r.score, 6)))
    for q in (3, 23, 43, 63):
        score = {i: sum(w * vectors[q].get(t, 0.0) for t, w in vectors.get(i, {}).items()) for i, _ in rows if i != q}
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        assert got[q] == [(i, round(score[i], 6)) for i in best]


def test_match_text_drops_unknown_words(spark, corpus):
    q = spark.createDataFrame([(7, "whale unknownword"), (8, "nothing here")], "q int, s string")
    got = text.match_text(corpus, q, "id", "t", "q", "s", 2).orderBy("query_id", "rank").collect()
    assert [(r["query_id"], r["id"]) for r in got] == [(7, 3), (7, 2), (8, 0), (8, 1)]


@pytest.mark.parametrize("least", [0.2, 0.5, 0.9])
def test_cosine_pairs_equal_brute_force(spark, corpus, least):
    weights = {}
    for r in text.tfidf(corpus, "id", "t").collect():
        weights.setdefault(r["id"], {})[r["term"]] = r["weight"]
    want = {}
    for a in (0, 2, 3, 5):
        for b in (2, 3, 5):
            s = sum(w * weights[b].get(t, 0.0) for t, w in weights[a].items())
            if a < b and round(s, 9) >= least:
                want[(a, b)] = round(s, 6)
    got = {(r["a"], r["b"]): round(r["score"], 6) for r in text.cosine_pairs(corpus, "id", "t", least).collect()}
    assert got == want
    copies = {r["id"]: r["n_copies"] for r in text.text_copies(corpus, "id", "t").collect()}
    assert copies == {0: 2, 2: 1, 3: 1, 4: 1, 5: 1}


def test_cosine_pairs_of_blocks(spark):
    """Blocks meet without a shuffle of partial scores; frequent terms go through a matrix product, rare ones one by one."""
    draw = random.Random(5)
    texts = [" ".join(draw.choices([f"w{i}" for i in range(40)], [1 / (i + 1) for i in range(40)], k=12)) for _ in range(90)]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    weights = {}
    for r in text.tfidf(rows, "id", "t").collect():
        weights.setdefault(r["id"], {})[r["term"]] = r["weight"]
    scores = {(a, b): sum(w * weights[b].get(t, 0.0) for t, w in weights[a].items()) for a in weights for b in weights if a < b}
    pairs = text.cosine_pairs(rows, "id", "t", 0.5, docs=32)
    assert {(r["a"], r["b"]): round(r["score"], 6) for r in pairs.collect()} == {p: round(x, 6) for p, x in scores.items() if round(x, 9) >= 0.5}
    plan = pairs._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" in plan and "Exchange" not in plan


def test_cosine_pairs_of_blocks_of_parts(spark, monkeypatch):
    """A block has several parts, which meet those of all blocks, their own included; ids are texts, some documents long."""
    monkeypatch.setattr(text, "POSTINGS", 150)
    draw = random.Random(6)
    words, share = [f"w{i}" for i in range(60)], [1 / (i + 1) for i in range(60)]
    rows = [(f"d{i}", " ".join(draw.choices(words, share, k=300 if i % 30 == 0 else 14))) for i in range(120)] + [("e", "lonely"), ("f", None)]
    df = spark.createDataFrame(rows, "id string, t string")
    weights = {}
    for r in text.tfidf(df, "id", "t").collect():
        weights.setdefault(r["id"], {})[r["term"]] = r["weight"]
    scores = {(a, b): sum(w * weights[b].get(t, 0.0) for t, w in weights[a].items()) for a in weights for b in weights if a < b}
    got = {(r["a"], r["b"]): round(r["score"], 6) for r in text.cosine_pairs(df, "id", "t", 0.4, docs=8).collect()}
    assert len(got) > 100 and got == {p: round(x, 6) for p, x in scores.items() if round(x, 9) >= 0.4}
    lone = df.join(text.text_copies(df, "id", "t"), "id")
    blocks = text._blocks(text.TfIdf.fit(lone, "id", "t", "n_copies"), 8)
    assert sum(len(r["ids"]) for r in blocks.collect()) == 120 and blocks.count() <= 8 + 120 // 16


def test_terms_are_counted_inside_their_row(spark):
    """No shuffle before the join with the term statistics."""
    texts = ["b bb aa bb aa bb", "", None, "Zz", "é éa éa 11 11 11"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id int, t string")
    posted = text.postings(rows, "id", "t")
    assert {tuple(r) for r in posted.collect()} == {(0, "bb", 3), (0, "aa", 2), (3, "zz", 1), (4, "éa", 2), (4, "11", 3)}
    assert "Exchange" not in posted._jdf.queryExecution().executedPlan().toString()


def test_title_lookup(spark):
    df = spark.createDataFrame([(3, " The Film"), (1, "the film "), (2, "Other")], "id int, title string")
    assert text.find_title(df, "id", "title", "THE FILM").first()["id"] == 1
    assert text.title_index(df, "id", "title").count() == 2


def test_html_text(spark):
    page = ("<!DOCTYPE html><html><head><STYLE>p{}</STYLE><script>var t='</p>';</script></head><body><nav><a>Menu</a></nav>"
            "<!-- ad --><p>A &amp;lt; B&nbsp;&copy;</p><br>x&eacute;<footer>end</footer></body></html>")
    df = frame(spark, [page])
    assert column(df.select(docs.html_text("v", every_entity=False).alias("x"))) == ["A &lt; B © x&eacute;"]
    assert column(df.select(docs.html_text("v").alias("x"))) == ["A &lt; B © xé"]


def test_words_preview_pieces(spark):
    df = frame(spark, ["", " a  b\n", "x" * 1500, "x" * 1501])
    assert column(df.select(docs.word_count("v").alias("x"))) == [0, 2, 1, 1]
    assert [len(v) for v in column(df.select(docs.preview("v").alias("x")))] == [0, 6, 1500, 1503]
    parts = docs.analysis_requests(frame(spark, ["", "abcdefg", None]), "v", "v", "I:", 3).collect()
    assert sorted((p.part, p.request) for p in parts) == [(0, "I:"), (0, "I:abc"), (1, "I:def"), (2, "I:g")]
    pieces = spark.createDataFrame([(1, 2, "b"), (1, 1, "a"), (1, 3, ""), (1, 4, " ")], "d int, s int, t string")
    assert docs.assemble_pieces(pieces, "d", "s", "t").first()["t"] == "a\nb\n "
    assert docs.assemble_pieces(pieces, "d", "s", "t", skip_blank=True).first()["t"] == "a\nb"


def test_analysis_records(spark):
    given = ['{"topic_category": "Scholarship", "easy_summary": null, "positives": ["p"], "chronology_history": [{"event": "e"}]}',
             '{"topic_category": "Sch', '{"topic_category": "Odd", "negatives": ["n1", "n2"]}']
    parsed = docs.parse_analysis(frame(spark, given).withColumnRenamed("v", "response"))
    assert [r["error"] for r in parsed.orderBy("id").collect()] == [None, given[1], None]
    flat = docs.analysis_fields(parsed, "id").orderBy("id").collect()
    assert [r["category"] for r in flat] == ["Scholarship", "Unclassified", "Odd"]
    assert flat[0]["summary"] == "No summary generated." and flat[1]["controversial_areas"] == "None detected"
    assert [tuple(r) for r in docs.chronology(parsed, "id").collect()] == [(0, 0, "Past Event", "e")]
    assert docs.pros_cons(parsed, "id").count() == 3
    assert {tuple(r) for r in docs.category_counts(parsed).collect()} == {("Scholarship", 1), ("Other", 2)}
    assert docs.report_rows(parsed, "id").count() == 27


def test_enrich_uses_one_client_per_partition(spark):
    def make_client():
        seen = []

        def answer(texts):
            seen.extend(texts)
            return [json.dumps({"easy_summary": str(len(seen))}) for _ in texts]
        return answer

    out = docs.enrich(frame(spark, ["a", "b", "c"]).coalesce(1), make_client, "v", "id")
    assert column(docs.parse_analysis(out).select(F.col("record.easy_summary").alias("x"))) == ["3", "3", "3"]


# --- sources ----------------------------------------------------------------------------------------------

def test_typed_table_and_append(spark):
    schema = T.StructType([T.StructField("name", T.StringType()), T.StructField("rate", T.DoubleType()),
                           T.StructField("votes", T.IntegerType()), T.StructField("scaled", T.DoubleType())])
    spark.sql("drop table if exists places")
    sources.save_typed_table(spark.createDataFrame([("a", "4.5", 3)], "name string, rate string, votes long"), "places", schema)
    sources.append_columns(spark.createDataFrame([("b", 9, "x")], "name string, votes int, extra string"), "places", ["name", "votes"])
    table = spark.table("places")
    assert table.schema == schema
    assert sorted(map(tuple, table.collect())) == [("a", 4.5, 3, None), ("b", None, 9, None)]
    got = sources.run_sql(spark, "select name from places where votes > :v", {"v": 5})
    assert column(got, "name") == ["b"]
    spark.sql("drop table places")


def test_csv_json_snapshot(spark, tmp_path):
    df = spark.createDataFrame([(1, 'a "quoted", text', None), (2, "line\nbreak", 2.5)], "i int, s string, d double")
    sources.write_csv(df, str(tmp_path / "c"))
    back = sources.read_table(spark, str(tmp_path / "c"), df.schema)
    assert sorted(back.collect()) == sorted(df.collect())
    assert sources.read_table(spark, str(tmp_path / "c")).dtypes == [("i", "int"), ("s", "string"), ("d", "double")]
    (tmp_path / "j.json").write_text('[{"a": 1, "b": "x"},\n {"a": 2}]')
    assert sorted(tuple(r) for r in sources.read_json(spark, str(tmp_path / "j.json")).collect()) == [(1, "x"), (2, None)]
    sources.write_snapshot(df, str(tmp_path / "p"))
    assert sources.read_snapshot(spark, str(tmp_path / "p")).dtypes == df.dtypes


def test_document_files(spark, tmp_path):
    (tmp_path / "A.TXT").write_bytes("café ".encode() + b"\xff\xfeok")
    (tmp_path / "b.pdf").write_bytes(b"%PDF")
    (tmp_path / "c.d.xlsx").write_bytes(b"x")
    files = sources.read_documents(spark, str(tmp_path))
    got = {r["extension"]: (r["supported"], r["text"]) for r in sources.document_text(files).collect()}
    assert got == {"txt": (True, "café ok"), "pdf": (True, None), "xlsx": (False, None)}


def test_column_cleaning_works_on_a_stream(spark, tmp_path):
    frame(spark, ["4.1/5", "NEW"]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("id int, v string").parquet(str(tmp_path / "in"))
    query = (stream.select(fn.parse_rating("v").alias("x")).writeStream.format("memory").queryName("rated")
             .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    query.awaitTermination(60)
    assert sorted(column(spark.table("rated")), key=str) == [4.1, None]


def test_index_helpers_survive_partition_counts(spark, prices):
    want = sorted(series.pct_change(prices).collect(), key=str)
    for n in (1, 32):
        assert sorted(series.pct_change(prices.repartition(n)).collect(), key=str) == want
    assert ordering.ordered_index(prices.repartition(32), ["date", "ticker"]).agg(F.max("row_index")).first()[0] == 7


def test_split_shares(spark):
    df = spark.range(1000)
    assert features.hash_split(df, "id", 1.0).filter("side = 'test'").count() == 1000
    assert features.hash_split(df, "id", 0.0).filter("side = 'test'").count() == 0


def test_grid_return_of_timestamps(spark):
    rows = [("a", f"2024-01-0{d} 10:00:00", float(d)) for d in range(1, 6)]
    prices = spark.createDataFrame(rows, "ticker string, date string, close double").withColumn("date", F.col("date").cast("timestamp"))
    for pad in (False, True):
        got = {str(r["date"]): r["grid_return"] for r in series.grid_return(prices, pad=pad).collect()}
        assert len(got) == 5 and got["2024-01-03"] == 0.5


def test_copy_groups(spark):
    df = spark.createDataFrame([(3, "x"), (1, "x"), (2, None), (4, ""), (5, "y")], "id long, t string")
    assert sorted(map(tuple, text.copy_groups(df, "id", "t").collect())) == [(1, 1), (2, 2), (3, 1), (4, 2), (5, 5)]


def test_empty_files(spark, tmp_path):
    (tmp_path / "a.txt").write_text("x")
    (tmp_path / "b.txt").write_text("")
    got = {r.path.rsplit("/", 1)[-1]: r.text for r in sources.document_text(sources.read_documents(spark, str(tmp_path))).collect()}
    assert got == {"a.txt": "x", "b.txt": ""}


def test_empty_files_without_a_call_for_each(spark, tmp_path, monkeypatch):
    """Names that need escapes, and folders below; the driver does not ask for the length and name of each file."""
    (tmp_path / "k=1").mkdir()
    for name in ("a b+c.txt", "é %20.txt", "k=1/x.txt"):
        (tmp_path / name).write_text("")
    (tmp_path / "full.txt").write_text("x")
    for i in range(200):
        (tmp_path / "k=1" / f"{i}.txt").write_text("x")
    client, calls = spark.sparkContext._gateway._gateway_client, []
    send = type(client).send_command
    monkeypatch.setattr(client, "send_command", lambda *a, **o: calls.append(a[0]) or send(client, *a, **o), raising=False)
    found = sources.read_documents(spark, str(tmp_path), recursive=True)
    monkeypatch.undo()
    assert sum(c.startswith("c") for c in calls) < 3 * 200
    found = found.filter("path not like '%/k=1/%' or path like '%x.txt'")
    got = {r["path"].removeprefix(f"file:{tmp_path}/"): bytes(r["content"]) for r in found.collect()}
    assert got == {"a b+c.txt": b"", "é %20.txt": b"", "k=1/x.txt": b"", "full.txt": b"x"}


def test_documents_written_are_read_again(spark, tmp_path):
    """A file a row, also of equal keys, empty and missing texts; by tasks and by Spark's writer; listed in few tasks."""
    rows = [(i, f"a {i}\nü") for i in range(60)] + [(7, "again"), (60, ""), (61, None), (None, "x")]
    df = spark.createDataFrame(rows, "k long, t string").repartition(5)
    want = sorted((str(k), (t or "") + "\n") for k, t in rows)
    before, tracker = spark.conf.get(files.LISTING), spark.sparkContext.statusTracker()
    for path in (f"file:{tmp_path}/own dir", f"file:///{tmp_path}/too".replace("////", "///"), str(tmp_path / "spark")):
        sources.write_documents(df if "spark" not in path else df.filter("t <> 'again'").union(df.filter("t is null")), path, "k", "t")
        spark.sparkContext.setJobGroup(path, path)
        found = sources.read_documents(spark, path, recursive=True)
        stages = [s for job in tracker.getJobIdsForGroup(path) for s in tracker.getJobInfo(job).stageIds]
        assert stages and max(tracker.getStageInfo(s).numTasks for s in stages) <= files.TURNS * spark.sparkContext.defaultParallelism
        spark.sparkContext.setJobGroup("", "")
        got = [(r["path"].split("k=")[1].split("/")[0].replace("__HIVE_DEFAULT_PARTITION__", "None"), r["text"]) for r in
               sources.document_text(found).collect()]
        assert sorted(got) == [w for w in want if "spark" not in path or w[1] != "again\n"]
    assert spark.conf.get(files.LISTING) == before
    with pytest.raises(FileExistsError):
        sources.write_documents(df, f"file:{tmp_path}/own dir", "k", "t")
    assert not [f for f in (tmp_path / "own dir").rglob("*") if f.name.startswith(".")]


def test_unknown_linear_option():
    with pytest.raises(TypeError):
        regress.MODELS["linear"][1](None, None, [], "y", "id", depth=3)


# --- bounded top-k ------------------------------------------------------------------------------------------

@pytest.mark.parametrize("budget", [60, 1_000_000])
def test_best_documents_need_few_rows(spark, budget):
    """The best documents equal those of all scores; frequent terms are looked up for few documents only."""
    draw = random.Random(3)
    common, rare = [f"co{i}" for i in range(6)], [f"ra{i}" for i in range(300)]
    rows = [(i, " ".join(draw.choices(common, k=3) + draw.choices(rare, k=12))) for i in range(400)] + [(400, ""), (401, None), (402, "co1")]
    df = spark.createDataFrame(rows, "id long, story string")
    model = text.TfIdf.fit(df, "id", "story")
    asked = spark.createDataFrame([(1, "co1 co2 ra3 ra4"), (2, rows[7][1]), (3, "co1"), (4, "nothing known"), (5, "")], "qid long, q string")
    weights = {}
    for r in model.weights().collect():
        weights.setdefault(r.id, {})[r.term] = r.weight
    want = set()
    vectors = {}
    for r in model.transform(asked, "qid", "q").collect():
        vectors.setdefault(r.query_id, {})[r.term] = r.q
    for qid in range(1, 6):
        q = vectors.get(qid, {})
        score = {i: sum(w * q.get(t, 0) for t, w in weights.get(i, {}).items()) for i, _ in rows}
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        want |= {(qid, i, rank, round(score[i], 6)) for rank, i in enumerate(best, 1)}
    got = text.match_text(df, asked, "id", "story", "qid", "q", 5, model).collect()
    assert {(r.query_id, r.id, r.rank, round(r.score, 6)) for r in got} == want
    trace = []
    found = model.best(model.transform(asked, "qid", "q"), 5, budget=budget, trace=trace)
    kept = {(r.query_id, r.id): r.score for r in found.collect()}
    for qid, i, _, score in want:
        assert score == 0 or round(kept[qid, i], 6) == score
    one = []
    model.best(model.transform(asked.filter("qid = 2"), "qid", "q"), 5, budget=budget, trace=one)
    if budget == 60:
        assert max(one) < 300  # of about 400 documents that share a term with it


# --- CSV in byte ranges -------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def small_ranges(spark):
    """Files are cut every few hundred bytes."""
    names = ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")
    for name in names:
        spark.conf.set(name, "300b")
    yield
    for name in names:
        spark.conf.unset(name)


def as_multi_line(spark, path, schema):
    return spark.read.options(header=True, multiLine=True, escape='"').schema(schema).csv(path)


@pytest.mark.parametrize("breaks", [0, 3])
@pytest.mark.parametrize("end", ["\n", "\r\n"])
def test_csv_ranges_equal_multi_line_reading(spark, tmp_path, small_ranges, breaks, end):
    """Quotes, commas and line breaks in texts, some over several ranges; two files, one of them ending within a line."""
    draw = random.Random(breaks)
    schema = "id int, story string, n double, note string"
    for part in range(2):
        lines = ["id,story,n,note"]
        for i in range(200):
            words = [draw.choice(["one", "zwei", "é", 'say ""yes""', "a,b", "x"]) for _ in range(draw.randint(0, 9))]
            if draw.random() < 0.2:
                words += [end] * breaks + ["tail"] * draw.choice([1, 1, 200])
            lines.append(f'{i},"{" ".join(words)}",{i / 4},{draw.choice(["", "plain", """ "" """.strip()])}')
        (tmp_path / f"part{part}.csv").write_bytes((end.join(lines) + (end if part else "")).encode())
    got = sources.read_table(spark, str(tmp_path), schema)
    want = as_multi_line(spark, str(tmp_path), schema)
    assert got.schema == want.schema
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect())) and got.count() == 400
    lines = spark.read.option("lineSep", "\n").text(str(tmp_path))
    assert lines.rdd.getNumPartitions() > 20
    inferred = sources.read_table(spark, str(tmp_path))
    assert [f.dataType.simpleString() for f in inferred.schema] == ["int", "string", "double", "string"]
    assert inferred.columns == ["id", "story", "n", "note"] and inferred.count() == 400


def test_csv_of_odd_files(spark, tmp_path):
    (tmp_path / "a.csv").write_text('a,"b\nc"\n1,"x\n\ny"\n\n2,\n')
    got = sources.read_table(spark, str(tmp_path / "a.csv"))
    assert got.columns == ["a", "b\nc"] and sorted(tuple(r) for r in got.collect()) == [(1, "x\n\ny"), (2, None)]
    (tmp_path / "b.csv").write_text("a,b\n")
    assert sources.read_table(spark, str(tmp_path / "b.csv"), "a int, b string").count() == 0
    (tmp_path / "c.csv").write_text("")
    assert sources.read_table(spark, str(tmp_path / "c.csv"), "a int").count() == 0


# --- correlation in blocks ----------------------------------------------------------------------------------

def test_correlation_of_many_keys(spark):
    """Hundreds of keys in several blocks, with gaps, a constant one and two without common dates."""
    draw = np.random.default_rng(5)
    dates = pd.date_range("2024-01-01", periods=40).strftime("%Y-%m-%d")
    wide = pd.DataFrame(100 * np.exp(np.cumsum(draw.normal(size=(40, 130)) * 0.02, axis=0)), index=dates, columns=[f"k{i:03d}" for i in range(130)])
    wide = wide.where(draw.random(wide.shape) > 0.1)
    wide["k005"] = 7.0
    wide.loc[dates[:20], "k010"], wide.loc[dates[20:], "k011"] = np.nan, np.nan
    rows = [(k, d, float(x)) for d, r in wide.iterrows() for k, x in r.items() if x == x]
    df = spark.createDataFrame(rows, "ticker string, date string, close double")
    keys = spark.createDataFrame([(f"k{i:03d}",) for i in range(0, 130)] + [("k999",)], "ticker string")
    got = {(r.a, r.b): r.corr for r in series.correlation(df, keys, width=32).collect()}
    returns = wide.pct_change(fill_method=None)
    n = returns.notna().astype(float).T @ returns.notna().astype(float)
    want = returns.corr()
    assert set(got) == {(a, b) for a in n for b in n if n.loc[a, b] > 0}
    for (a, b), corr in got.items():
        if "k005" in (a, b) or n.loc[a, b] == 1:
            assert corr is None
        else:
            assert abs(corr - want.loc[a, b]) < 1e-9
    one = {(r.a, r.b): r.corr for r in series.correlation(df, ["k000", "k001"]).collect()}
    assert len(one) == 4 and abs(one["k000", "k001"] - got["k000", "k001"]) < 1e-12
    assert series.correlation(df.limit(0)).count() == 0
