"""Side-by-side comparison of registered queries with their SQL. Usage: python tests/check.py [sf] [names...]"""

import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from millrace.plans.fixtures import TABLES  # noqa: E402

ROOT = "/root/testdata"


def duck(sf_dir):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def normal(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])

    def cell(v):
        if v is None or (isinstance(v, float) and v != v):
            return (0, "")
        if isinstance(v, bool):
            return (1, int(v))
        if isinstance(v, (int, float)):
            return (1, round(float(v), 6) + 0.0)
        return (2, str(v))

    return sorted(tuple(cell(r[i]) for i in order) for r in rows)


def compare(df, con, sql):
    """None when equal, else a description of the first difference."""
    got = [tuple(r) for r in df.collect()]
    cur = con.execute(sql)
    names = [d[0] for d in cur.description]
    want = cur.fetchall()
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} vs {sorted(names)}"
    if len(got) != len(want):
        return f"rows {len(got)} vs {len(want)}"
    for g, w in zip(normal(got, df.columns), normal(want, names)):
        if g != w and not all(
            a == b or (a[0] == b[0] == 1 and abs(a[1] - b[1]) <= 1e-9 * max(1.0, abs(a[1]))) for a, b in zip(g, w)
        ):
            return f"{g} vs {w}"
    kinds = {"BIGINT": "bigint", "INTEGER": "int", "DOUBLE": "double", "VARCHAR": "string", "DATE": "date", "BOOLEAN": "boolean"}
    spark_types = dict(df.dtypes)
    for name, kind in ((d[0], str(d[1])) for d in cur.description):
        if kinds.get(kind, kind) != spark_types[name]:
            return f"type of {name}: {spark_types[name]} vs {kind}"
    return None


if __name__ == "__main__":
    import __spark_entry__ as entry
    from millrace.session import local_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    names = sys.argv[2:]
    spark = local_session(8)
    con = duck(f"{ROOT}/sf{sf}")
    queries, sql = entry.queries(), entry.oracle_sql()
    for name, run in queries.items():
        if names and name not in names:
            continue
        start = time.time()
        try:
            df = run(spark, f"{ROOT}/sf{sf}")
            if name in sql:
                diff = compare(df, con, sql[name])
            else:
                diff = None if df.count() else "no rows"
        except Exception as e:  # noqa: BLE001
            diff = f"{type(e).__name__}: {str(e)[:600]}"
        print(f"{'ok  ' if diff is None else 'FAIL'} {name:24s} {time.time() - start:6.2f}s {'' if name in sql else '(rows only)'} {diff or ''}",
              flush=True)
