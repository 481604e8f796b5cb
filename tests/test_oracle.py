"""Every registered query against its SQL (MILLRACE_SF picks the scale factor)."""

import os

import pytest

import __spark_entry__ as entry
from check import ROOT, compare, duck

from millrace.plans import registry

SF = os.environ.get("MILLRACE_SF", "0.001")
SQL = registry.oracle_sql()


@pytest.fixture(scope="module")
def con():
    return duck(f"{ROOT}/sf{SF}")


def test_every_sql_has_a_query():
    assert set(SQL) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["location", "average_rating"] and out.count() > 0


@pytest.mark.parametrize("name", sorted(SQL))
def test_matches_sql(spark, con, name):
    assert compare(entry.queries()[name](spark, f"{ROOT}/sf{SF}"), con, SQL[name]) is None


@pytest.mark.parametrize("name", sorted(set(registry.queries()) - set(SQL)))
def test_rows_only(spark, name):
    assert entry.queries()[name](spark, f"{ROOT}/sf{SF}").count() > 0
