"""Price series queries: keyed returns, monthly rankings, and the single daily series."""

from __future__ import annotations

from pyspark.sql import functions as F

from millrace import functions as fn
from millrace.operators import clean, features, filters, forecast, series
from millrace.plans import sqltext as q
from millrace.plans.fixtures import view

QUERIES: dict = {}
SQL: dict = {}


def query(name, sql=None):
    def register(f):
        QUERIES[name] = f
        if sql:
            SQL[name] = sql
        return f
    return register


def prices(spark, sf):
    return view(spark, sf, "prices")


def as_text(df, *columns):
    return df.withColumns({c: F.col(c).cast("string") for c in columns})


def r6(df, *columns):
    return df.withColumns({c: F.round(c, 6) for c in columns})


# --- keyed series -----------------------------------------------------------------------------------------

RETURNS = """returns as (select ticker, date, close, close / lag(close) over (partition by ticker order by date) - 1
    as daily_return from prices)"""
ENDS = """ends as (select ticker, arg_min(close, date) as first, arg_max(close, date) as last from prices
    where close is not null group by ticker), totals as (select ticker, first, last, (last - first) / first as ret from ends)"""
MONTHLY = """monthly as (select strftime(date, '%Y-%m') as month, ticker, arg_min(close, date) as first,
    arg_max(close, date) as last from prices group by 1, 2),
    ranked as (select *, (last - first) / first * 100 as ret from monthly)"""


@query("suffix_symbol", """select distinct ticker, case when contains(ticker, 'AN') then ticker
    else concat(ticker, 'AN') end as symbol from prices""")
def suffix_symbol(spark, sf):
    tickers = prices(spark, sf).select("ticker").distinct()
    return tickers.select("ticker", fn.add_suffix("ticker", "AN").alias("symbol"))


@query("daily_return", f"with {RETURNS} select ticker, cast(date as varchar) as date, close, "
       "round(daily_return, 6) as daily_return from returns")
def daily_return(spark, sf):
    return as_text(r6(series.pct_change(prices(spark, sf)), "daily_return"), "date")


@query("volatility_top10", f"""with {RETURNS} select ticker, round(volatility, 6) as volatility from (select ticker,
    stddev_samp(daily_return) as volatility from returns group by ticker) where volatility is not null
    order by volatility desc, ticker limit 10""")
def volatility_top10(spark, sf):
    return r6(series.volatility(series.pct_change(prices(spark, sf))), "volatility")


@query("first_last", f"with {ENDS} select ticker, first, last from ends")
def first_last(spark, sf):
    return series.first_last(prices(spark, sf), ["ticker"])


@query("total_return", f"""with {ENDS} select ticker, first, last, round(ret, 6) as "return" from totals""")
def total_return(spark, sf):
    return r6(series.total_return(prices(spark, sf)), "return")


@query("cum_return_top5", f"""with {ENDS}, best as (select ticker, first from totals order by ret desc, ticker limit 5)
    select ticker, cast(date as varchar) as date, close, first as baseline,
    round((close - first) / first, 6) as cum_return from prices join best using (ticker)""")
def cum_return_top5(spark, sf):
    return as_text(r6(series.cumulative_return(prices(spark, sf)), "cum_return"), "date").select(
        "ticker", "date", "close", "baseline", "cum_return")


@query("semi_topk", f"""with {ENDS} select ticker, cast(date as varchar) as date, close from prices where ticker in
    (select ticker from totals order by ret desc, ticker limit 5)""")
def semi_topk(spark, sf):
    rows = prices(spark, sf)
    best = series.top_keys(series.total_return(rows), "ticker", "return", 5)
    return as_text(filters.in_keys(rows, best, "ticker"), "date")


@query("monthly_return", f"""with {MONTHLY} select month, ticker, first, last, round(ret, 6) as "return" from ranked""")
def monthly_return(spark, sf):
    return r6(series.monthly_return(prices(spark, sf)), "return")


@query("gainers_losers", f"""with {MONTHLY},
    d as (select *, row_number() over (partition by month order by ret desc nulls last, ticker) as rank from ranked),
    u as (select *, row_number() over (partition by month order by ret asc nulls first, ticker desc) as rank from ranked)
    select month, ticker, round(ret, 6) as "return", cast(rank as int) as rank, 'gainer' as side from d where rank <= 5
    union all select month, ticker, round(ret, 6), cast(rank as int), 'loser' from u where rank <= 5""")
def gainers_losers(spark, sf):
    out = series.gainers_losers(series.monthly_return(prices(spark, sf)))
    return r6(out, "return").select("month", "ticker", "return", "rank", "side")


@query("sector_join", f"""with {ENDS} select ticker, round(ret, 6) as "return", coalesce(sector, 'Other') as sector
    from totals left join sectors using (ticker)""")
def sector_join(spark, sf):
    out = series.join_sector(series.total_return(prices(spark, sf)), view(spark, sf, "sectors"))
    return r6(out, "return").select("ticker", "return", "sector")


@query("sector_rollup", f"""with {ENDS} select sector, round(avg(ret), 6) as average_return,
    string_agg(ticker, ', ' order by ticker) as members from (select ticker, ret, coalesce(sector, 'Other') as sector
    from totals left join sectors using (ticker)) group by sector""")
def sector_rollup(spark, sf):
    joined = series.join_sector(series.total_return(prices(spark, sf)), view(spark, sf, "sectors"))
    return r6(series.sector_rollup(joined), "average_return")


GRID = """days as (select date, lag(date) over (order by date) as prev from (select distinct date from prices)),
    grid_returns as (select p.ticker, p.date, p.close, p.close / b.close - 1 as ret from prices p
    join days d on p.date = d.date left join prices b on b.ticker = p.ticker and b.date = d.prev)"""
PADDED = """days as (select distinct date from prices), spine as (select ticker, d.date from days d
    join (select ticker, min(date) as start from prices group by ticker) t on d.date >= t.start),
    filled as (select s.ticker, s.date, last_value(p.close ignore nulls) over (partition by s.ticker order by s.date
    rows between unbounded preceding and current row) as close from spine s left join prices p
    on p.ticker = s.ticker and p.date = s.date),
    padded as (select ticker, date, close, close / lag(close) over (partition by ticker order by date) - 1 as ret from filled)"""


@query("grid_return", f"with {GRID} select ticker, cast(date as varchar) as date, close, round(ret, 6) as grid_return "
       "from grid_returns")
def grid_return(spark, sf):
    return as_text(r6(series.grid_return(prices(spark, sf)), "grid_return"), "date")


@query("grid_return_padded", f"with {PADDED} select ticker, cast(date as varchar) as date, close, "
       "round(ret, 6) + 0.0 as grid_return from padded")
def grid_return_padded(spark, sf):
    return as_text(r6(series.grid_return(prices(spark, sf), pad=True), "grid_return"), "date")


@query("correlation", f"""with {GRID}, c as (select a.ticker as a, b.ticker as b, case when count(*) > 1 then corr(a.ret, b.ret) end as corr
    from grid_returns a join grid_returns b on a.date = b.date where a.ret is not null and b.ret is not null group by 1, 2)
    select a, b, round(case when isnan(corr) then null else corr end, 6) + 0.0 as corr from c""")
def correlation(spark, sf):
    keys = view(spark, sf, "nation").select(F.col("n_name").alias("ticker"))  # the picked tickers
    return r6(series.correlation(prices(spark, sf), keys), "corr")


@query("pivot_cum_return", f"""with {ENDS}, best as (select ticker, first, row_number() over (order by ret desc, ticker) as r
    from totals), cum as (select r, date, (close - first) / first as c from prices join best using (ticker) where r <= 5)
    select cast(date as varchar) as date, {', '.join(f'round(max(case when r = {i} then c end), 6) as top{i}' for i in range(1, 6))}
    from cum group by date""")
def pivot_cum_return(spark, sf):
    rows = prices(spark, sf)
    best = [r[0] for r in series.top_keys(series.total_return(rows), "ticker", "return", 5).collect()]  # five keys
    wide = series.pivot_series(series.cumulative_return(rows), best, value="cum_return")
    named = wide.withColumnsRenamed({k: f"top{i + 1}" for i, k in enumerate(best)})
    missing = {f"top{i}": F.lit(None).cast("double") for i in range(len(best) + 1, 6)}
    return as_text(r6(named.withColumns(missing) if missing else named, *[f"top{i}" for i in range(1, 6)]), "date")


# --- daily series -----------------------------------------------------------------------------------------

DAILY = f"""typed as (select cast(strptime(date_text, '%d-%m-%Y') as date) as date, {q.plain_number('price_text')} as price,
    {q.magnitude('volume_text')} as volume from series_raw),
    daily as (select *, row_number() over (order by date) - 1 as row_index, count(*) over () as n from typed)"""
SPLIT = f"{DAILY}, split as (select *, case when row_index < floor(n * 0.8) then 'train' else 'test' end as side from daily)"
SCALED = f"""{SPLIT}, span as (select min(price) as lo, max(price) as hi from split where side = 'train'),
    scaled as (select row_index, side, price, (price - lo) / (hi - lo) as x from split, span)"""


def daily(spark, sf):
    raw = view(spark, sf, "series_raw")
    return raw.select(
        fn.parse_date("date_text").alias("date"), fn.parse_number("price_text").alias("price"),
        fn.parse_magnitude("volume_text").alias("volume"),
    )


def indexed(spark, sf):
    return series.row_index(daily(spark, sf), ["date"])


@query("parse_date", "select date_text, cast(cast(strptime(date_text, '%d-%m-%Y') as date) as varchar) as date from series_raw")
def parse_date(spark, sf):
    return view(spark, sf, "series_raw").select("date_text", fn.parse_date("date_text").cast("string").alias("date"))


@query("parse_magnitude", f"select volume_text, {q.magnitude('volume_text')} as volume, cast(count(*) as bigint) as n, "
       f"cast(sum({q.magnitude('volume_text')}) as double) as total from series_raw group by 1, 2")
def parse_magnitude(spark, sf):
    rows = view(spark, sf, "series_raw").select("volume_text", fn.parse_magnitude("volume_text").alias("volume"))
    return rows.groupBy("volume_text", "volume").agg(F.count("*").alias("n"), F.sum("volume").alias("total"))


@query("fill_median", f"with {DAILY} select cast(date as varchar) as date, "
       "coalesce(volume, (select median(volume) from typed)) as volume from daily")
def fill_median(spark, sf):
    return as_text(clean.fill_median(daily(spark, sf), "volume").select("date", "volume"), "date")


@query("ffill", f"""with {DAILY} select cast(date as varchar) as date, last_value(volume ignore nulls) over (order by date
    rows between unbounded preceding and current row) as volume from daily""")
def ffill(spark, sf):
    return as_text(clean.ffill(daily(spark, sf).select("date", "volume"), "volume", "date"), "date")


@query("row_index", f"with {DAILY} select cast(date as varchar) as date, price, row_index from daily")
def row_index(spark, sf):
    return as_text(indexed(spark, sf).select("date", "price", "row_index"), "date")


@query("time_split", f"""with {SPLIT} select side, count(*) as n_rows, cast(min(date) as varchar) as first,
    cast(max(date) as varchar) as last, min(row_index) as first_row, max(row_index) as last_row from split group by side""")
def time_split(spark, sf):
    out = series.time_split(indexed(spark, sf)).groupBy("side").agg(
        F.count("*").alias("n_rows"), F.min("date").alias("first"), F.max("date").alias("last"),
        F.min("row_index").alias("first_row"), F.max("row_index").alias("last_row"))
    return as_text(out, "first", "last")


def sequence_sql(source, x, n):
    return f"""select row_index as sample, list({x}) over (order by row_index rows between current row and 59 following) as win,
    lead({x}, 60) over (order by row_index) as label_1, lead({x}, 62) over (order by row_index) as label_3,
    lead({x}, 66) over (order by row_index) as label_7, {n} as n from {source}"""


@query("sequences", f"""with {DAILY}, s as ({sequence_sql('daily', 'price', 'n')})
    select sample, cast(step as int) as step, win[step + 1] as value, label_1, label_3, label_7
    from s, unnest(range(0, 60)) as r(step) where sample < n - 67""")
def sequences(spark, sf):
    out = series.sequences(indexed(spark, sf), "price")
    return out.select("sample", F.posexplode("window").alias("step", "value"), "label_1", "label_3", "label_7")


@query("latest_window", f"""with {DAILY} select cast(row_index - n + 1 as int) as step, row_index, price from daily
    where row_index >= n - 60""")
def latest_window(spark, sf):
    return series.latest_window(indexed(spark, sf), "price")


@query("trajectory", f"""with {DAILY} select cast(row_index - n + 1 as int) as step, price as value, 'actual' as kind from daily
    where row_index >= n - 60 union all select h, price, 'forecast' from daily, (values (1), (3), (7)) as v(h)
    where row_index = n - 1""")
def trajectory(spark, sf):
    rows = indexed(spark, sf)
    window = rows.agg(F.max("row_index").alias("sample"), F.array(F.max_by("price", "row_index")).alias("window"))
    ahead = forecast.predict_horizons(window, {})
    return series.trajectory(series.latest_window(rows, "price"), ahead, "price")


@query("minmax_scale", f"with {SCALED} select row_index, side, round(x, 6) as x from scaled")
def minmax_scale(spark, sf):
    split = series.time_split(indexed(spark, sf))
    scale = features.MinMaxScale.fit(split.filter("side = 'train'"), "price")
    return split.select("row_index", "side", F.round(scale.scaled(F.col("price")), 6).alias("x"))


@query("minmax_inverse", f"with {SCALED} select row_index, round(x * (hi - lo) + lo, 6) as price from scaled, span")
def minmax_inverse(spark, sf):
    split = series.time_split(indexed(spark, sf))
    scale = features.MinMaxScale.fit(split.filter("side = 'train'"), "price")
    x = split.select("row_index", scale.scaled(F.col("price")).alias("x"))
    return x.select("row_index", F.round(scale.inverse(F.col("x")), 6).alias("price"))


TEST_FORECAST = f"""{SPLIT}, t as (select price, row_number() over (order by row_index) - 1 as row_index, count(*) over () as m
    from split where side = 'test'), s as ({sequence_sql('t', 'price', 'm')}),
    f as (select sample, h as horizon, win[60] as forecast, case h when 1 then label_1 when 3 then label_3 else label_7 end
    as actual from s, (values (1), (3), (7)) as v(h) where sample < n - 67)"""


def prepared(spark, sf):
    return forecast.prepare(series.time_split(indexed(spark, sf)), "price")


@query("forecast_persistence", f"with {TEST_FORECAST} select sample, horizon, round(forecast, 6) as forecast, "
       "round(actual, 6) as actual from f")
def forecast_persistence(spark, sf):
    p = prepared(spark, sf)
    return r6(forecast.forecast(p.train, p.test, "persistence", p.scale), "forecast", "actual")


@query("horizon_metrics", f"""with {TEST_FORECAST} select horizon, round(avg(abs(actual - forecast)), 6) as mae,
    round(sqrt(avg((actual - forecast) ** 2)), 6) as rmse,
    round(avg(abs((actual - forecast) / nullif(actual, 0))) * 100, 6) as mape,
    round(avg(abs((actual - forecast) / (actual + 2.220446049250313e-16))) * 100, 6) as mape_eps from f group by horizon""")
def horizon_metrics(spark, sf):
    p = prepared(spark, sf)
    out = forecast.horizon_metrics(forecast.forecast(p.train, p.test, "persistence", p.scale))
    return r6(out, "mae", "rmse", "mape", "mape_eps")


@query("forecast_linear")
def forecast_linear(spark, sf):
    p = prepared(spark, sf)
    return r6(forecast.forecast(p.train, p.test, "linear", p.scale), "forecast", "actual")


@query("forecast_comparison")
def forecast_comparison(spark, sf):
    return forecast.forecast_comparison(forecast.run_kinds(prepared(spark, sf), ["persistence", "linear", "forest", "gbt"]))


HOLDOUT_FORECAST = f"""{SCALED}, t as (select price, row_number() over (order by row_index) - 1 as row_index, count(*) over () as m
    from split where side = 'train'), s as ({sequence_sql('t', 'price', 'm')}),
    f as (select h as horizon, win[60] as forecast, case h when 1 then label_1 when 3 then label_3 else label_7 end
    as actual from s, (values (1), (3), (7)) as v(h) where sample < n - 67 and sample >= floor((n - 67) * 0.9))"""


@query("forecast_holdout", f"""with {HOLDOUT_FORECAST} select 'persistence' as model, horizon, round(avg(abs(actual - forecast)), 6) as mae,
    round(sqrt(avg((actual - forecast) ** 2)), 6) as rmse from f group by horizon""")
def forecast_holdout(spark, sf):
    out = forecast.holdout_metrics(prepared(spark, sf), ["persistence"])
    return r6(out.select("model", "horizon", "mae", "rmse"), "mae", "rmse")


@query("forecast_holdout_linear")
def forecast_holdout_linear(spark, sf):
    return forecast.holdout_metrics(prepared(spark, sf), ["linear"])


@query("forecast_latest")
def forecast_latest(spark, sf):
    rows = indexed(spark, sf)
    p = forecast.prepare(series.time_split(rows), "price")
    window = forecast.last_window(rows, "price", p.scale)
    return forecast.forecast_latest(p, window, ["persistence", "linear", "forest"])
