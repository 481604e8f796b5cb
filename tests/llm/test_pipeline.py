"""The corpus pipeline, stage by stage, and the registered queries."""

import random
import re

import __spark_entry__ as entry
import corpus_pipeline
import pytest
from check import compare, duck
from test_near_dedup import brute
from test_rules import base_spans, plain_measures

from millrace.llm import mixing, quality, queries

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    """A small corpus with copies, leaks, junk and secrets, and a benchmark."""
    draw = random.Random(12)
    word = lambda: "".join(draw.choice("abcdefgh") for _ in range(draw.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(25))) for i in range(5)]
    rows = []
    for i in range(120):
        text = [word() for _ in range(draw.randint(30, 120))]
        if i % 10 == 1:
            text = rows[-1][1].split(" ")
            text[draw.randrange(len(text))] = word()
        elif i % 10 == 3:
            text[5:5] = items[i % 5][1].split(" ")
        elif i % 10 == 5:
            text = text[:10] * 9
        elif i % 10 == 7:
            text.insert(4, "password=abcdef123456")
        rows.append((i, " ".join(text), "en", None if i % 7 == 0 else f"s{i % 3}", 0))
    rows += [(500, None, None, None, None), (501, "", "en", "s1", 0), (None, rows[0][1] + " new end", "en", "s1", 9), rows[2]]
    out = tmp_path_factory.mktemp("corpus")
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{out}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{out}/benchmark.parquet")
    return str(out), rows, items


def test_stages_equal_plain_versions(spark, folder):
    where, rows, items = folder
    docs = spark.read.parquet(f"{where}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, where)
        assert docs.columns[: len(COLUMNS)] == COLUMNS
        kept[name] = docs.collect()
        docs = spark.createDataFrame(kept[name], docs.schema)

    def good(text):
        n, _, symbols, _, repeat, shares = plain_measures(text)
        return n >= 20 and 100 * repeat <= 30 * n and symbols <= 0.2 * n and all(
            s <= quality.MOST_IN_GRAMS[k] for k, s in zip(quality.LENGTHS, shares))

    want = [r for r in rows if good(r[1])]
    assert sorted(map(str, map(tuple, kept["quality_rules"]))) == sorted(map(str, want))
    groups = brute([r[:2] for r in want if r[0] is not None], 5, 80)
    want = {r for r in want if r[0] is None or groups[r[0]][1] == r[0]}
    assert sorted(map(str, map(tuple, kept["near_dedup"]))) == sorted(map(str, want))
    want = {r for r in want if not any(item in r[1] for _, item in items)}
    assert sorted(map(str, map(tuple, kept["decontamination"]))) == sorted(map(str, want))

    def masked(text):
        for s, e in sorted(((int(s), int(e)) for _, s, e in (x.split(":") for x in base_spans(text))), reverse=True):
            text = text[:s] + "[SECRET]" + text[e:]
        return text

    want = {(i, masked(t), lang, source, len(masked(t))) for i, t, lang, source, _ in want}
    assert {tuple(r) for r in kept["secret_scan"]} == want
    sizes = {r.doc_id: r for r in mixing.mix_sizes(spark.createDataFrame(kept["secret_scan"])).collect()}
    assert sorted((r.doc_id or -1, r.repeat) for r in kept["mixing"]) == sorted(
        (i or -1, k) for i, r in sizes.items() for k in range(1, r.repeats + 1))


def test_run_is_all_stages(spark, folder):
    where, *_ = folder
    out = corpus_pipeline.run(spark, where)
    assert out.columns == [*COLUMNS, "repeat"] and out.count() > 0
    assert out.where("text rlike 'password='").count() == 0


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_matches_sql(spark, name):
    assert compare(queries.QUERIES[name](spark, SF), duck_tables(), queries.SQL[name]) is None


def duck_tables():
    con = duck(SF)
    for t in ("documents", "labels", "pages", "benchmark", "conversations"):
        con.execute(f"create or replace view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", sorted(set(queries.QUERIES) - set(queries.SQL)))
def test_rows(spark, name):
    source = "pages" if "page" in name else "documents"
    rows = queries.QUERIES[name](spark, SF).count()
    if "decontamination" not in name:
        assert rows == spark.read.parquet(f"{SF}/{source}.parquet").count()


def test_all_are_registered():
    assert {*queries.QUERIES, "pipeline"} <= set(entry.queries())
    numbers = {int(re.match(r"op(\d+)_", n)[1]) for n in queries.QUERIES}
    assert numbers == set(range(1, 14))
