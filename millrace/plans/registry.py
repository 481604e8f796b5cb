"""All registered queries."""

from __future__ import annotations

from millrace.plans import models, prices, reports, texts
from millrace.plans.fixtures import with_views

MODULES = (reports, prices, models, texts)


def queries() -> dict:
    return {name: run for module in MODULES for name, run in module.QUERIES.items()}


def oracle_sql() -> dict[str, str]:
    return {name: with_views(sql) for module in MODULES for name, sql in module.SQL.items()}
