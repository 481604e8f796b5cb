"""Views that give the shared tables the shapes the operators expect.

The text is accepted by Spark and by DuckDB, so queries and their SQL counterparts start from the same rows.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession

from millrace.session import checkpoint_folder

TABLES = (
    "region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings", "pages",
    "benchmark", "labels", "conversations",
)

VIEWS = {}

VIEWS["restaurants_raw"] = r"""
select p_partkey as row_id, p_name as name,
       case when p_partkey % 2 = 0 then 'Yes' else 'No' end as online_order,
       case when p_partkey % 3 = 0 then 'Yes' else 'No' end as book_table,
       case when p_partkey % 17 = 0 then 'NEW' when p_partkey % 23 = 0 then '-' when p_partkey % 29 = 0 then 'nan'
            when p_partkey % 31 = 0 then null
            else concat(cast(cast(1 + (p_partkey * 7 % 41) / 10.0 as decimal(2,1)) as string), '/5') end as rate_raw,
       cast(p_partkey % 997 as int) as votes, p_brand as location, p_type as cuisines,
       case when p_partkey % 37 = 0 then null
            when p_size >= 20 then concat(cast(cast(floor(p_size * 50 / 1000) as int) as string), ',', lpad(cast(p_size * 50 % 1000 as string), 3, '0'))
            else cast(p_size * 50 as string) end as cost_raw
from part
"""

VIEWS["restaurants_dup"] = r"""
select * from restaurants_raw union all select * from restaurants_raw where row_id % 50 = 0
"""

VIEWS["orders_data"] = r"""
select cast(o_orderkey as string) as order_id, c_name as restaurant_name, cast(o_orderdate as date) as order_date,
       cast(o_totalprice as decimal(10,2)) as order_value,
       case when o_orderkey % 3 = 0 then 'Yes' when o_orderkey % 3 = 1 then 'No' else null end as discount_used,
       o_orderpriority as payment_method
from orders join customer on o_custkey = c_custkey
"""

VIEWS["prices"] = r"""
select n_name as ticker, cast(l_shipdate as date) as date, max(l_extendedprice) as close
from lineitem join supplier on l_suppkey = s_suppkey join nation on s_nationkey = n_nationkey
group by n_name, cast(l_shipdate as date)
"""

VIEWS["sectors"] = r"""
select n_name as ticker, r_name as sector from nation join region on n_regionkey = r_regionkey where n_nationkey % 6 <> 5
"""

VIEWS["series_raw"] = r"""
select concat(lpad(cast(day(d) as string), 2, '0'), '-', lpad(cast(month(d) as string), 2, '0'), '-', cast(year(d) as string)) as date_text,
       case when w >= 1000 then concat(cast(cast(floor(w / 1000) as bigint) as string), ',', lpad(cast(w % 1000 as string), 3, '0'), '.5')
            else concat(cast(w as string), '.5') end as price_text,
       case when day(d) = 13 then '-' when day(d) = 20 then concat(' ', cast(n as string), '.25m ')
            when day(d) = 27 then cast(n * 1000 as string) when day(d) = 9 then concat(cast(n as string), 'B')
            else concat(cast(n as string), '.5K') end as volume_text
from (select cast(o_orderdate as date) as d, cast(floor(max(o_totalprice)) as bigint) as w, count(*) as n from orders group by cast(o_orderdate as date)) t
"""

VIEWS["workouts"] = r"""
select p_partkey as id, cast(p_size as double) as age, cast(50 + p_partkey * 11 % 70 as double) as weight,
       cast(100 + p_partkey * 13 % 80 as double) as max_bpm, cast(p_partkey % 7 as double) as frequency,
       case when p_partkey % 2 = 0 then 'Male' else 'Female' end as gender, p_type as workout_type,
       case when p_partkey % 101 = 0 then 1e1 else 1e0 end * (cast(p_size as double) * 12 + cast(p_partkey * 13 % 80 as double) * 3 + cast(p_partkey * 17 % 23 as double)) as calories
from part
"""

VIEWS["points"] = r"""
select s_suppkey as id, s_acctbal / 1000 as x, cast(s_nationkey as double) as y from supplier
"""

VIEWS["movies"] = r"""
select doc_id as row_id, concat(case when doc_id % 2 = 0 then ' Film ' else 'FILM ' end, cast(cast(floor(doc_id / 4) as bigint) as string)) as title,
       case when doc_id % 41 = 0 then null else text end as storyline
from documents
"""

VIEWS["analysis_json"] = r"""
select doc_id, case when doc_id % 37 = 0 then '{"topic_category": "Schol'
  else concat('{"topic_category": "', case doc_id % 5 when 0 then 'Accreditation' when 1 then 'Scholarship' when 2 then 'Curriculum' when 3 then 'Examination' else 'Unlisted' end, '"',
    case when doc_id % 4 = 0 then '' else concat(', "easy_summary": "summary ', cast(doc_id as string), '"') end,
    ', "chronology_history": ', case when doc_id % 3 = 0 then '[]' else '[{"year_or_phase": "2019", "event": "first"}, {"event": "second"}]' end,
    ', "stakeholder_impact": {"students": "s', cast(doc_id % 10 as string), '"}',
    ', "positives": ["p1", "p2"]', case when doc_id % 2 = 0 then ', "negatives": ["n1"]' else '' end, '}') end as response
from documents
"""


def _sources(text: str) -> list[str]:
    return [n for n in (*TABLES, *VIEWS) if re.search(rf"\b(?:from|join)\s+{n}\b", text)]


def view_order(names) -> list[str]:
    """The views in ``names`` and all they are built on, in dependency order."""
    done: list[str] = []

    def visit(name):
        if name in VIEWS and name not in done:
            for source in _sources(VIEWS[name]):
                visit(source)
            done.append(name)

    for n in names:
        visit(n)
    return done


def with_views(sql: str) -> str:
    """Prefix a statement with the definitions of the views it reads."""
    defined = ", ".join(f"{n} as ({VIEWS[n].strip()})" for n in view_order(_sources(sql)))
    if not defined:
        return sql
    head = sql.lstrip()
    for start in ("with recursive ", "with "):
        if head.startswith(start):
            return f"{start}{defined}, {head[len(start):]}"
    return f"with {defined} {head}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A shared table or one of the views above."""
    if name in TABLES:
        return table(spark, sf_dir, name)
    order = view_order([name])
    for source in {s for v in order for s in _sources(VIEWS[v]) if s in TABLES}:
        table(spark, sf_dir, source).createOrReplaceTempView(source)
    return spark.sql(with_views(f"select * from {name}"))


def scratch_path(spark: SparkSession) -> str:
    """A fresh path next to the checkpoints, which all executors can reach."""
    return f"{checkpoint_folder(spark)}/{uuid.uuid4().hex}"
