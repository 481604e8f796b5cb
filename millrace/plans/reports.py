"""Restaurant and order queries: sources, profiling, cleaning, filters, grouped reports."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, functions as F, types as T

from millrace import functions as fn, sources
from millrace.operators import clean, filters, profile, rollups
from millrace.plans import sqltext as q
from millrace.plans.fixtures import scratch_path, view
from millrace.session import write_and_read

NUMERIC = ["age", "weight", "max_bpm", "calories"]
PLACES = ["Brand#11", "Brand#23", "Brand#42"]


def restaurants(spark, sf, filled: bool = True) -> DataFrame:
    """The typed restaurants table: rating and cost parsed, missing ratings set to the mean."""
    raw = view(spark, sf, "restaurants_raw")
    typed = raw.select(
        "row_id", "name", "online_order", "book_table", fn.parse_rating("rate_raw").alias("rate"), "votes", "location",
        "cuisines", fn.parse_number("cost_raw").alias("cost"),
    )
    return clean.fill_mean(typed, "rate") if filled else typed


TYPED = f"""parsed as (select row_id, name, online_order, book_table, {q.rating('rate_raw')} as rate, votes, location,
    cuisines, {q.plain_number('cost_raw')} as cost from restaurants_raw),
restaurants as (select row_id, name, online_order, book_table, coalesce(rate, (select avg(rate) from parsed)) as rate,
    votes, location, cuisines, cost from parsed)"""


def typed(sql: str) -> str:
    return f"with {TYPED} {sql}"


def orders(spark, sf) -> DataFrame:
    return view(spark, sf, "orders_data")


def r6(*names):
    return [F.round(n, 6).alias(n) for n in names]


QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return register


# --- sources ----------------------------------------------------------------------------------------------

RAW_COLUMNS = "row_id, name, online_order, book_table, rate_raw, votes, location, cuisines, cost_raw"


@query("csv_roundtrip", f"select {RAW_COLUMNS} from restaurants_raw")
def csv_roundtrip(spark, sf):
    raw = view(spark, sf, "restaurants_raw")
    path = scratch_path(spark)
    sources.write_csv(raw, path)
    return sources.read_table(spark, path, raw.schema)


@query("json_roundtrip", f"select {RAW_COLUMNS} from restaurants_raw")
def json_roundtrip(spark, sf):
    raw = view(spark, sf, "restaurants_raw")
    path = scratch_path(spark)
    raw.write.json(path)
    return sources.read_json(spark, path, raw.schema, array=False).select(*raw.columns)


@query("json_array", f"select {RAW_COLUMNS} from restaurants_raw")
def json_array(spark, sf):
    """Files that hold one JSON array each."""
    raw = view(spark, sf, "restaurants_raw")
    part = F.pmod(F.xxhash64("row_id"), F.lit(16)).alias("part")
    path = scratch_path(spark)
    arrays = raw.groupBy(part).agg(F.to_json(F.collect_list(F.struct(*raw.columns))).alias("value"))
    arrays.write.partitionBy("part").text(path)
    return sources.read_json(spark, path, raw.schema).select(*raw.columns)


@query("typed_tables", """select cast(row_id as varchar) as row_id, name, cast(votes as bigint) as votes, cast(null as varchar) as note
    from restaurants_raw union all select cast(row_id as varchar), name, null, null from restaurants_raw where row_id % 50 = 0""")
def typed_tables(spark, sf):
    """A table with declared types, rows appended with some of its columns, read back."""
    raw = view(spark, sf, "restaurants_raw")
    name = f"typed_{uuid.uuid4().hex}"
    sources.save_typed_table(raw, name, T.StructType.fromDDL("row_id string, name string, votes bigint, note string"))
    sources.append_columns(raw.filter("row_id % 50 = 0").select("row_id", "name"), name, ["row_id", "name"])
    back = write_and_read(spark.table(name))
    spark.sql(f"drop table {name}")
    return back


@query("files_roundtrip", "select page_id, html as text from pages")
def files_roundtrip(spark, sf):
    """A folder for each page with its text as one file."""
    path = scratch_path(spark)
    sources.write_documents(view(spark, sf, "pages"), path, "page_id", "html")
    found = sources.document_text(sources.read_documents(spark, path, recursive=True))
    return found.select(F.regexp_extract("path", "page_id=([0-9]+)/", 1).cast("long").alias("page_id"),
                        F.expr("substr(text, 1, length(text) - 1)").alias("text"))  # without the line's end


@query("tidy_columns", """select row_id as "Row_id", coalesce(rate_raw, 'none') as "Rating", votes as "Votes" from restaurants_raw""")
def tidy_columns(spark, sf):
    raw = view(spark, sf, "restaurants_raw").select(
        F.col("row_id").alias(" ROW_ID "), F.col("rate_raw").alias("rate raw"), F.col("votes").alias("VOTES"), "name", "location")
    tidy = clean.rename_columns(clean.tidy_headers(raw), {"Rate raw": "Rating"})
    kept = clean.drop_columns(clean.keep_columns(tidy, ["Row_id", "Rating", "Votes", "Name", "Absent"]), ["Name", "Unknown"])
    return clean.fill_constant(kept, "none", ["Rating"])


@query("snapshot_roundtrip", "select order_id, cast(order_date as varchar) as order_date, "
       "cast(order_value as double) as order_value, payment_method from orders_data")
def snapshot_roundtrip(spark, sf):
    path = scratch_path(spark)
    sources.write_snapshot(orders(spark, sf), path)
    back = sources.read_snapshot(spark, path)
    return back.select(
        "order_id", F.col("order_date").cast("string"), F.col("order_value").cast("double"), "payment_method"
    )


@query("run_sql", typed("select name, location, rate from restaurants where rate >= 4.0").replace(
    "select name, location, rate from", "select name, location, round(rate, 6) as rate from"))
def run_sql(spark, sf):
    text = "select name, location, round(rate, 6) as rate from {restaurants} where rate >= :low"
    return sources.run_sql(spark, text, {"low": 4.0}, {"restaurants": restaurants(spark, sf)})


# --- profiling --------------------------------------------------------------------------------------------

RAW_NAMES = RAW_COLUMNS.split(", ")


@query("null_counts", " union all ".join(
    f"""select '{c}' as "column", count(*) - count({c}) as n_null from restaurants_raw""" for c in RAW_NAMES))
def null_counts(spark, sf):
    return profile.null_counts(view(spark, sf, "restaurants_raw"), RAW_NAMES)


@query("row_null_counts", """select row_id, n_null from (select row_id, cast(case when rate_raw is null then 1 else 0 end
    + case when cost_raw is null then 1 else 0 end as int) as n_null from restaurants_raw) where n_null > 0""")
def row_null_counts(spark, sf):
    return profile.row_null_counts(view(spark, sf, "restaurants_raw"), "row_id")


@query("describe", " union all ".join(
    f"""select '{c}' as "column", count({c}) as "count", round(avg({c}), 6) as mean, round(stddev_samp({c}), 6) as std,
    min({c}) as min, quantile_cont({c}, 0.25) as p25, quantile_cont({c}, 0.5) as p50, quantile_cont({c}, 0.75) as p75,
    max({c}) as max from workouts""" for c in NUMERIC))
def describe(spark, sf):
    out = profile.describe(view(spark, sf, "workouts"), NUMERIC)
    return out.withColumns({c: F.round(c, 6) for c in ("mean", "std")})


@query("table_extent", "select count(*) as n_rows, cast(min(order_date) as varchar) as first, "
       "cast(max(order_date) as varchar) as last from orders_data")
def table_extent(spark, sf):
    out = profile.table_extent(orders(spark, sf), "order_date")
    return out.withColumns({c: F.col(c).cast("string") for c in ("first", "last")})


@query("distinct_values", "select location, min(row_id) as first_row from restaurants_raw group by location")
def distinct_values(spark, sf):
    return profile.distinct_values(view(spark, sf, "restaurants_raw"), "location", "row_id")


@query("box_summary", " union all ".join(
    f"""select '{c}' as "column", min(case when {c} >= q1 - 1.5 * (q3 - q1) then {c} end) as whisker_low,
    any_value(q1) as q1, any_value(q2) as median, any_value(q3) as q3,
    max(case when {c} <= q3 + 1.5 * (q3 - q1) then {c} end) as whisker_high,
    count(case when {c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1) then 1 end) as n_outliers
    from workouts, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.5) as q2, quantile_cont({c}, 0.75) as q3
    from workouts)""" for c in NUMERIC))
def box_summary(spark, sf):
    return profile.box_summary(view(spark, sf, "workouts"), NUMERIC)


@query("quantiles", " union all ".join(
    f"""select 'l_extendedprice' as "column", cast({p} as double) as p,
    round(quantile_cont(l_extendedprice, {p}), 6) as value from lineitem""" for p in (0.05, 0.25, 0.5, 0.75, 0.95)))
def quantiles(spark, sf):
    out = profile.quantiles(view(spark, sf, "lineitem"), ["l_extendedprice"], [0.05, 0.25, 0.5, 0.75, 0.95])
    return out.withColumn("value", F.round("value", 6))


# --- cleaning ---------------------------------------------------------------------------------------------

@query("dedupe_rows", f"select distinct {RAW_COLUMNS} from restaurants_dup")
def dedupe_rows(spark, sf):
    return clean.dedupe_rows(view(spark, sf, "restaurants_dup"))


@query("duplicate_keys", "select row_id, count(*) as n_rows from restaurants_dup group by row_id having count(*) > 1")
def duplicate_keys(spark, sf):
    return clean.duplicate_keys(view(spark, sf, "restaurants_dup"), ["row_id"])


@query("dedupe_first", """select row_id, title, coalesce(storyline, '') as storyline from
    (select *, row_number() over (partition by title order by row_id) as rn from movies) where rn = 1""")
def dedupe_first(spark, sf):
    return clean.fill_constant(clean.dedupe_first(view(spark, sf, "movies"), ["title"], ["row_id"]), "", ["storyline"])


@query("parse_rating", f"select row_id, rate_raw, {q.rating('rate_raw')} as rate from restaurants_raw")
def parse_rating(spark, sf):
    return view(spark, sf, "restaurants_raw").select("row_id", "rate_raw", fn.parse_rating("rate_raw").alias("rate"))


@query("fill_mean", typed("select row_id, round(rate, 6) as rate from restaurants"))
def fill_mean(spark, sf):
    return restaurants(spark, sf).select("row_id", *r6("rate"))


@query("parse_number", f"select row_id, cost_raw, {q.plain_number('cost_raw')} as cost from restaurants_raw")
def parse_number(spark, sf):
    return view(spark, sf, "restaurants_raw").select("row_id", "cost_raw", fn.parse_number("cost_raw").alias("cost"))


@query("flag_to_int", "select order_id, case when discount_used = 'Yes' then 1 else 0 end as discount_used from orders_data")
def flag_to_int(spark, sf):
    return orders(spark, sf).select("order_id", fn.yes_flag("discount_used").alias("discount_used"))


NAN_CASE = "case when row_id % 7 = 0 then cast('nan' as double) when row_id % 11 = 0 then null else votes * 0.5 end"


@query("nan_to_null", f"select row_id, case when isnan(x) then null else x end as x from "
       f"(select row_id, {NAN_CASE} as x from restaurants_raw)")
def nan_to_null(spark, sf):
    rows = view(spark, sf, "restaurants_raw").select("row_id", F.expr(NAN_CASE).cast("double").alias("x"))
    return rows.withColumn("x", fn.drop_nan("x"))


@query("fill_constant", """select row_id, title, coalesce(storyline, '') as storyline from movies""")
def fill_constant(spark, sf):
    return clean.fill_constant(view(spark, sf, "movies"), "")


# --- filters ----------------------------------------------------------------------------------------------

SHOWN = ["row_id", "name", "rate", "location", "cost", "cuisines"]
SHOWN_SQL = "select row_id, name, round(rate, 6) as rate, location, cost, cuisines from restaurants"


def shown(df):
    return df.withColumn("rate", F.round("rate", 6))


@query("filter_all", typed(f"{SHOWN_SQL} where rate >= 2.5 and cost between 300 and 800 and online_order = 'Yes' "
                           "and book_table = 'Yes'"))
def filter_all(spark, sf):
    return shown(filters.apply_filters(restaurants(spark, sf), ["All"], 2.5, "Mid-Range", True, True, SHOWN))


@query("filter_location", typed(f"{SHOWN_SQL} where location in ('Brand#11', 'Brand#23', 'Brand#42') and rate >= 3.0"))
def filter_location(spark, sf):
    return shown(filters.apply_filters(restaurants(spark, sf), PLACES, 3.0, columns=SHOWN))


@query("filter_tier", typed("""select tier, count(*) as n, sum(votes)::bigint as votes from (select votes, case when cost < 300 then 'Budget'
    when cost > 800 then 'Premium' when cost is not null then 'Mid-Range' end as tier from restaurants)
    where tier is not null group by tier"""))
def filter_tier(spark, sf):
    rows = restaurants(spark, sf).withColumn("tier", filters.price_tier("cost")).where("tier is not null")
    return rows.groupBy("tier").agg(F.count("*").alias("n"), F.sum("votes").alias("votes"))


# --- grouped reports --------------------------------------------------------------------------------------

@query("top_mean_location", typed("""select location, round(average_rating, 6) as average_rating from (select location,
    avg(rate) as average_rating from restaurants group by location order by 2 desc, 1 limit 10)"""))
def top_mean_location(spark, sf):
    out = rollups.top_mean(restaurants(spark, sf), "location", "rate", 10, "average_rating")
    return out.select("location", *r6("average_rating"))


@query("top_mean_cuisine", typed("""select cuisines, round(average_rating, 6) as average_rating from (select cuisines,
    avg(rate) as average_rating from restaurants group by cuisines order by 2 desc, 1 limit 10)"""))
def top_mean_cuisine(spark, sf):
    out = rollups.top_mean(restaurants(spark, sf), "cuisines", "rate", 10, "average_rating")
    return out.select("cuisines", *r6("average_rating"))


@query("top_count_location", typed("""select location, count(name) as restaurant_count from restaurants group by location
    order by 2 desc, 1 limit 20"""))
def top_count_location(spark, sf):
    return rollups.top_count(restaurants(spark, sf), "location", "name", 20, "restaurant_count")


@query("top_count_cuisine", typed("""select cuisines, count(name) as restaurant_count from restaurants group by cuisines
    order by 2 desc, 1 limit 10"""))
def top_count_cuisine(spark, sf):
    return rollups.top_count(restaurants(spark, sf), "cuisines", "name", 10, "restaurant_count")


@query("mean_by_online", typed("select online_order, round(avg(rate), 6) as average_rating from restaurants group by online_order"))
def mean_by_online(spark, sf):
    out = rollups.mean_by(restaurants(spark, sf), ["online_order"], "rate", "average_rating")
    return out.select("online_order", *r6("average_rating"))


@query("mean_by_booking", typed("select book_table, round(avg(rate), 6) as average_rating from restaurants group by book_table"))
def mean_by_booking(spark, sf):
    out = rollups.mean_by(restaurants(spark, sf), ["book_table"], "rate", "average_rating")
    return out.select("book_table", *r6("average_rating"))


@query("ideal_locations", typed("""select location, round(average, 6) as average_rating, n as restaurant_count from (
    select location, avg(rate) as average, count(name) as n from restaurants group by location
    order by 2 desc, 3, 1 limit 10)"""))
def ideal_locations(spark, sf):
    out = rollups.ideal_groups(restaurants(spark, sf), "location", "rate", "name", 10)
    return out.select("location", F.round("average", 6).alias("average_rating"), F.col("n").alias("restaurant_count"))


@query("mean_by_two_flags", typed("""select online_order, book_table, round(avg(rate), 6) as average_rating
    from restaurants group by online_order, book_table"""))
def mean_by_two_flags(spark, sf):
    out = rollups.mean_by(restaurants(spark, sf), ["online_order", "book_table"], "rate", "average_rating")
    return out.orderBy(F.desc("average_rating"), "online_order", "book_table").select(
        "online_order", "book_table", *r6("average_rating"))


@query("revenue_by_restaurant", """select restaurant_name, cast(sum(order_value) as double) as total_revenue
    from orders_data group by restaurant_name""")
def revenue_by_restaurant(spark, sf):
    out = rollups.sum_by(orders(spark, sf), "restaurant_name", "order_value", "total_revenue")
    return out.orderBy(F.desc("total_revenue"), "restaurant_name").withColumn(
        "total_revenue", F.col("total_revenue").cast("double"))


@query("orders_by_payment", """select payment_method, count(order_id) as number_of_orders from orders_data
    group by payment_method""")
def orders_by_payment(spark, sf):
    out = rollups.count_by(orders(spark, sf), "payment_method", "order_id", "number_of_orders")
    return out.orderBy(F.desc("number_of_orders"), "payment_method")


@query("avg_order_value", "select round(avg(cast(order_value as double)), 4) as average_order_value from orders_data")
def avg_order_value(spark, sf):
    out = rollups.overall_mean(orders(spark, sf), "order_value", "average_order_value")
    return out.select(F.round(F.col("average_order_value").cast("double"), 4).alias("average_order_value"))


@query("discount_split", """select case when discount_used = 'Yes' then 'Yes' else 'No' end as discount_status,
    count(order_id) as number_of_orders from orders_data group by 1""")
def discount_split(spark, sf):
    rows = orders(spark, sf).withColumn("discount_used", fn.yes_flag("discount_used"))
    case = F.when(F.col("discount_used") == 1, "Yes").otherwise("No")
    return rollups.count_by_case(rows, case, "order_id", "discount_status", "number_of_orders")


@query("top5_restaurants", """select restaurant_name, count(order_id) as total_orders from orders_data
    group by restaurant_name order by 2 desc, 1 limit 5""")
def top5_restaurants(spark, sf):
    return rollups.top_count(orders(spark, sf), "restaurant_name", "order_id", 5, "total_orders")


BIN_SQL = "case " + " ".join(
    f"when cost >= 0 and cost < {e} then '{label}'" for e, label in zip(rollups.PRICE_EDGES[1:-1], rollups.PRICE_LABELS)
) + " when cost >= 0 then '>2000' end"


@query("price_bins", typed(f"""select b.bin, round(m.average, 6) as average from (values {', '.join(
    f"('{label}')" for label in rollups.PRICE_LABELS)}) as b(bin) left join (select {BIN_SQL} as bin, avg(rate) as average
    from restaurants where rate is not null group by 1) m on b.bin = m.bin"""))
def price_bins(spark, sf):
    return rollups.bin_mean(restaurants(spark, sf), "cost", "rate").select("bin", *r6("average"))


@query("top_per_segment", typed(f"""select bin, row_id, name, round(rate, 6) as rate, cost, rank from (
    select *, cast(row_number() over (partition by bin order by rate desc, row_id) as int) as rank from (
    select *, {BIN_SQL} as bin from restaurants where rate is not null) where bin is not null) where rank <= 5"""))
def top_per_segment(spark, sf):
    rows = restaurants(spark, sf).withColumn("bin", rollups.bin_label("cost"))
    out = rollups.top_per_segment(rows, "bin", "rate", "row_id", 5)
    return out.select("bin", "row_id", "name", *r6("rate"), "cost", "rank")
