"""Queries of the composed jobs."""

import uuid

from pyspark.sql import functions as F

from wattframe.functions import calendar
from wattframe.operators import metrics, quality, reshape, splits
from wattframe.plans import balance, demand, market, site
from wattframe.session import checkpoint_folder
from wattframe.sources.tables import build_manifest
from wattframe.suite import checks, decompositions as deco, resources as res
from wattframe.suite.forecasts import _HOLT_ALL
from wattframe.suite.panels import R
from wattframe.suite.registry import query, rounded
from wattframe.suite.shapes import GRID_SQL
from wattframe.suite.views import LOCATIONS


def _target():
    return F.col("region_id") == "view"


# --- balance ----------------------------------------------------------------------------------------------

_LONG = "g as (" + GRID_SQL.strip().replace("\nwith", "with") + """),
long as (select sheet as year, 'TJ' as unit, section, line_item, fuel, fuel_group, value from (
  select *, row_number() over (partition by sheet, line_item, fuel order by row_idx, col_idx) as k from g) t where k = 1)"""


def _balance(v):
    cells = v.cells.withColumnRenamed("sheet", "year").withColumn("unit", F.lit("TJ"))
    return balance.build_balance(cells, "year", "unit", group_lines=["A (+)", "N (+)"])


@query("p1_balance_long", f"with {_LONG} select year, unit, section, line_item, fuel, fuel_group, round(value, 2) as value from long")
def balance_long(v):
    return rounded(_balance(v)["balance_long"], 2)


@query("p1_balance_by_group", f"""
with {_LONG} select year, unit, fuel_group, line_item, round(sum(value), 2) as value from long where line_item in ('A (+)', 'N (+)') group by 1, 2, 3, 4""")
def balance_by_group(v):
    return rounded(_balance(v)["by_fuel_group"], 2)


@query("p1_balance_quality", f"""
with {_LONG} select 'rows by year,unit' as section, concat_ws('/', year, unit) as item, count(*) as n from long group by 2
union all select 'rows by section', concat_ws('/', section), count(*) from long group by 2
union all select 'distinct', 'line_item', count(distinct line_item) from long union all select 'distinct', 'fuel_group', count(distinct fuel_group) from long
union all select 'distinct', 'fuel', count(distinct fuel) from long""")
def balance_quality(v):
    return _balance(v)["quality"]


@query("p1_balance_wide", """
with t as (select line_item, yr, fuel_group, sum(value) as value from fx_balance_long where unit = 'TJ' group by 1, 2, 3)
select line_item, """ + ", ".join(
    f"round(sum(value) filter (yr = {y} and fuel_group = '{g}'), 2) as \"{y}__{g.lower()}\""
    for y in range(1995, 2002) for g in ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + " from t group by 1")
def balance_wide(v):
    long = v.balance_long.withColumn("year", F.col("yr")).withColumn("fuel", F.col("fuel_group"))
    return rounded(balance.balance_wide(long, "TJ"), 2)


@query("p1_wide_of_cells", f"""
with {_LONG}, w as (select line_item, year, fuel, sum(value) as value from long where unit = 'TJ' group by 1, 2, 3)
select line_item, trim(regexp_replace(lower(concat(year, '__', fuel)), '[^0-9a-z_]+', '_', 'g'), '_') as col, round(value, 2) as value from w where value is not null""")
def wide_of_cells(v):
    """The wide table that the balance job makes of its cells, read back as rows."""
    wide = _balance(v)["wide_TJ"]
    return rounded(reshape.melt(wide, ["line_item"], [c for c in wide.columns if c != "line_item"], "col", "value").filter("value is not null"), 2)


# --- market and series ------------------------------------------------------------------------------------

def _market_rows(v, money):
    """Market files as text rows; an amount that is NULL is written as a word."""
    k, day = F.col("event_id"), F.col("ts").cast("date")
    north = F.col("event_type").isin("view", "click")
    name = F.concat(F.lit("Январь 2024 "), F.when(north, "Север-Юг").otherwise("Запад"), F.lit(" "), F.col("event_type"), F.lit(".xlsx"))
    hour = F.hour("ts")
    return v.t("events").select(
        name.alias("file_name"), F.when(north, F.date_format(day, "yyyy-MM-dd")).otherwise(F.date_format(day, "dd.MM.yyyy")).alias("date_txt"),
        F.concat_ws("-", hour.cast("string"), ((hour + 1) % 24).cast("string")).alias("hour_txt"),
        F.when(k % 2 == 0, " Up").otherwise("down ").alias("direction"),
        *[F.coalesce(c.cast("string"), F.lit("n/a")).alias(name) for name, c in money.items()])


def _raw_market(v):
    return _market_rows(v, {"payment": F.when(F.col("event_id") % 25 != 0, F.col("value"))})


@query("p2_market_monthly", """
select 2024::int as year, 1::int as month, case when event_type in ('view', 'click') then 'North-South' else 'West' end as zone, count(*) as rows,
  round(sum(case when event_id % 25 <> 0 then value else 0 end), 2) as total_payment from events group by 3""")
def market_monthly(v):
    m = market.build_market_hourly(_raw_market(v), {"up": "up", "down": "down"}, ["payment"])
    return rounded(m["monthly"], 2)


@query("p2_market_hourly", """
select cast(ts as date) as date, cast(hour(ts) as int) as hour, case when event_id % 2 = 0 then 'up' else 'down' end as direction,
  case when event_type in ('view', 'click') then 'North-South' else 'West' end as zone, count(*) as n, count(case when event_id % 25 <> 0 then 1 end) as n_paid
from events group by 1, 2, 3, 4""")
def market_hourly(v):
    m = market.build_market_hourly(_raw_market(v), {"up": "up", "down": "down"}, ["payment"])
    return m["hourly"].groupBy("date", "hour", "direction", "zone").agg(F.count("*").alias("n"), F.count("payment").alias("n_paid"))


MONEY = ("earnings_up", "earnings_down", "payment_to_supplier", "payment_to_system_op")


@query("p2_market_money", """
with m as (select case when event_type in ('view', 'click') then 'North-South' else 'West' end as zone, case when event_id % 25 <> 0 then value end as a,
  case when event_id % 2 = 0 then value * 2 end as b, case when event_id % 3 = 0 then -value end as c, value / 4 as d from events)
select 2024::int as year, 1::int as month, zone, count(*) as rows, round(coalesce(sum(a), 0), 2) as total_earnings_up, round(coalesce(sum(b), 0), 2) as total_earnings_down,
  round(coalesce(sum(c), 0), 2) as total_payment_to_supplier, round(coalesce(sum(d), 0), 2) as total_payment_to_system_op from m group by 3""")
def market_money(v):
    """Monthly totals of all four money columns, each with texts that are no numbers."""
    k, x = F.col("event_id"), F.col("value")
    raw = _market_rows(v, {
        "earnings_up": F.when(k % 25 != 0, x), "earnings_down": F.when(k % 2 == 0, x * 2), "payment_to_supplier": F.when(k % 3 == 0, -x), "payment_to_system_op": x / 4})
    return rounded(market.build_market_hourly(raw, {"up": "up", "down": "down"}, MONEY)["monthly"], 2)


def _facts(v):
    f = v.facts.select("yr", "metric", "value_bkwh", "source_year_report")
    found = f.select("yr", (F.col("value_bkwh") + (F.col("yr") % 3) * 0.4).alias("value_bkwh"))
    return balance.build_verified_balance(f, found, "yr", "metric", "value_bkwh", "source_year_report")


@query("p3_verified_balance", """
select yr::int as yr, round(max(value_bkwh) filter (metric = 'F'), 4) as "F", round(max(value_bkwh) filter (metric = 'O'), 4) as "O" from fx_facts group by 1""")
def verified_balance(v):
    return rounded(_facts(v)["wide"], 4)


@query("p3_fact_audit", """
with b as (select yr, value_bkwh + (yr % 3) * 0.4 as v from fx_facts)
select yr::int as yr, metric, source_year_report::int as source_year_report, round(value_bkwh, 4) as value_bkwh,
  exists (select 1 from b where b.yr = a.yr and abs(a.value_bkwh - b.v) <= 0.5) as confirmed from fx_facts a""")
def fact_audit(v):
    return rounded(_facts(v)["audit"], 4)


def _countries(v):
    m = v.monthly_zone.groupBy("yr", "zone").agg(F.sum("total").alias("gdp"), F.sum("n").alias("population"))
    m = m.withColumn("gdp", F.when(F.col("yr") % 3 != 0, F.col("gdp")))
    return balance.extract_country(m, "ASIA", 1997, ["year", "country", "gdp", "population", "co2"], ["gdp", "co2"],
                                   ["ASIA", "EUROPE", "AFRICA", "AMERICA"], 1999, ("gdp", "population"), {"yr": "year", "zone": "country"})


@query("p4_extract_country", """
with m as (select yr, zone, case when yr % 3 <> 0 then sum(total) end as gdp, sum(n)::bigint as population from fx_monthly_zone group by 1, 2)
select yr::int as year, zone as country, round(gdp, 2) as gdp, population, case when gdp is null then 1 else 0 end as gdp_missing_flag, 1 as co2_missing_flag
from m where zone = 'ASIA' and yr >= 1997""")
def extract_country(v):
    return rounded(_countries(v)["country"], 2)


@query("p4_peer_comparison", """
with m as (select zone, sum(total) / sum(n) as per_capita from fx_monthly_zone where yr = 1999 and zone <> 'MIDDLE EAST' group by 1)
select zone as country, round(per_capita, 4) as per_capita, rank() over (order by per_capita desc) as rank from m""")
def peer_comparison(v):
    return rounded(_countries(v)["peers"], 4)


def _more_countries(v):
    """The extract with its recent years, and a search over all columns of the nations."""
    m = v.monthly_zone.groupBy("yr", "zone").agg(F.sum("total").alias("gdp"), F.sum("n").alias("population"))
    n = v.t("nation").join(v.t("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")
    return balance.extract_country(m, "ASIA", 1995, ["year", "country", "gdp", "population"], ["gdp"], ["ASIA"], 1999, ("gdp", "population"), {"yr": "year", "zone": "country"},
                                   recent=1996, searched=(n, "AsIa"))


@query("p4_recent_years", "select yr::int as year, zone as country, round(sum(total), 2) as gdp, sum(n)::bigint as population from fx_monthly_zone where zone = 'ASIA' and yr >= 1996 group by 1, 2")
def recent_years(v):
    return rounded(_more_countries(v)["recent"], 2)


@query("p4_mentions", """
select n_nationkey, n_name, r_name from nation join region on n_regionkey = r_regionkey where contains(lower(concat_ws(' ', n_nationkey, n_name, r_name)), 'asia')""")
def mentions(v):
    return _more_countries(v)["mentions"]


def _macro_refreshed(v):
    old = v.monthly_zone.groupBy(F.col("yr").cast("string").alias("year"), F.col("zone").alias("country")).agg(F.sum("total").alias("gdp"), F.sum("n").alias("jobs"))
    old = old.withColumn("gdp", F.when(F.col("year") != "1996", F.col("gdp"))).unionByName(v.literal([("n/a", "ASIA", 1.0, 1)], "year string, country string, gdp double, jobs bigint"))
    new = old.filter("year > '1994' and country <> 'AFRICA'").select("year", "country", (F.col("gdp") * 3).alias("gdp"), F.lit("x").alias("unknown"))
    return market.refresh_by_year(old, new, "year", ["gdp", "jobs", "co2"], 1997, 1995, ["country"])


_MACRO = """o as (select yr as year, zone as country, case when yr <> 1996 then sum(total) end as gdp, sum(n)::bigint as jobs from fx_monthly_zone group by 1, 2),
r as (select year, country, case when year >= 1995 and country <> 'AFRICA' then gdp * 3 else gdp end as gdp, case when year >= 1995 and country <> 'AFRICA' then null else jobs end as jobs
  from o where year <= 1997)"""


@query("p5_macro_refreshed", f"""
with {_MACRO} select year::int as year, country, round(gdp, 2) as gdp, jobs, (gdp is null)::int as gdp_missing_flag, (jobs is null)::int as jobs_missing_flag, 1::int as co2_missing_flag from r""")
def macro_refreshed(v):
    """Yearly rows where a newer source wins, as whole rows."""
    return rounded(_macro_refreshed(v)["rows"], 2)


@query("p5_macro_report", f"""
with {_MACRO} select 'gdp' as "column", count(*) filter (gdp is null) as n_missing from r union all select 'jobs', count(*) filter (jobs is null) from r union all select 'co2', count(*) from r""")
def macro_report(v):
    return _macro_refreshed(v)["report"]


def _generation(v):
    e = v.t("events").select("event_id", F.when(F.col("user_id") % 4 == 0, " Net Imports").otherwise(F.col("event_type")).alias("variable"),
                             F.when(F.col("event_id") % 7 == 0, -F.col("value")).otherwise(F.col("value")).cast("string").alias("value"))
    return market.clean_generation(e, "value", "variable")


@query("p5_generation_signs", """
select user_id % 4 = 0 as imports, count(*) as n, count(*) filter (event_id % 7 <> 0 or value <= 0 or user_id % 4 = 0) as n_ok,
  round(coalesce(sum(case when event_id % 7 = 0 then case when user_id % 4 = 0 or value <= 0 then -value end else value end), 0), 2) as total from events group by 1""")
def generation_signs(v):
    rows = _generation(v)["rows"]
    return rounded(rows.groupBy((F.col("variable") == " Net Imports").alias("imports")).agg(F.count("*").alias("n"), F.count_if("sign_ok").alias("n_ok"), F.sum("value").alias("total")), 2)


@query("p5_generation_report", """
select count(*) filter (event_id % 7 = 0 and value > 0) as n_negative, count(*) filter (event_id % 7 = 0 and value > 0 and user_id % 4 = 0) as n_allowed,
  count(*) filter (event_id % 7 = 0 and value > 0 and user_id % 4 <> 0) as n_nulled from events""")
def generation_report(v):
    return _generation(v)["report"]


def _cleaned(v):
    raw = checks.raw_series(v).drop("ts")
    return market.clean_series(raw, ["series"], "txt", ["v"], "event_id")


_CLEAN = f"""{checks.RAW_SQL}, good as (select series, ts, v from (select *, row_number() over (partition by series, ts order by event_id) as k
  from flagged where v is not null and ts is not null) t where k = 1)"""


@query("p5_clean_series", f"with {_CLEAN} select series, ts, v from good")
def clean_series(v):
    return _cleaned(v)["rows"]


@query("p5_missing_hours", f"""
with {_CLEAN}, e as (select series, min(ts) as a, max(ts) as z from good group by 1),
g as (select series, unnest(generate_series(a, z, interval 1 hour)) as ts from e)
select g.series, g.ts from g left join good using (series, ts) where good.v is null""")
def missing_hours(v):
    return _cleaned(v)["missing"]


@query("p5_cleaning_report", checks.CLEANING_SQL)
def cleaning_report(v):
    return _cleaned(v)["report"]


# --- demand -----------------------------------------------------------------------------------------------

def _tables(v):
    cap = v.daily.select(F.col("d").cast("timestamp_ntz").alias("ts"), F.lit("cf").alias("region_id"), (F.col("cf") - 0.3).alias("wind_cf"),
                         F.col("cf").alias("solar_cf"))
    macro = v.monthly_zone.groupBy(F.col("yr").alias("year"), F.col("zone").alias("region_id")).agg(F.sum("total").alias("industry_index"))
    newer = macro.filter("year >= 2000").withColumn("industry_index", F.col("industry_index") * 2)
    return demand.build_forecast_tables(v.load_wide, "ts", deco.two_sources(v), ("a", "b"), "KZ_SYSTEM", cap, [macro, newer])


@query("p6_forecast_load", f"""
with {deco.FALLBACK_SQL},
prof as (select month(ts) as month, isodow(ts) - 1 as dow, hour(ts) as hour, avg(y) as weight from fx_hourly group by 1, 2, 3),
dem as (select yr, mo, coalesce(a, b * ratio) as demand, case when a is not null then 'official' else 'scaled' end as source from w, r where coalesce(a, b) is not null),
s as (select 'KZ_SYSTEM' as region_id, 'monthly_disaggregated_' || source as source, 1 as is_synthetic, sum(day(last_day(make_date(yr, mo, 1))) * 24)::bigint as n,
  sum(demand) * 1000 as total from dem group by 2)
select region_id, source, is_synthetic, n, round(total / 1e6, 3) as total from s
union all select region_id, 'measured', 0, count(*), round(sum(y) / 1e6, 3) from fx_hourly group by 1""")
def forecast_load(v):
    load = _tables(v)["load"]
    return rounded(load.groupBy("region_id", "source", "is_synthetic").agg(F.count("*").alias("n"), (F.sum("load_mw") / 1e6).alias("total")), 3)


@query("p6_forecast_manifest", """
with {0} select 'calendar' as tbl, '0' as grp, count(*) as n_rows, min(ts) as first_ts, max(ts) as last_ts from (
  select distinct ts from (select ts from fx_hourly union all select ts from grid) a) b
union all select 'weather', 'cf', count(*), min(cast(d as timestamp)), max(cast(d as timestamp)) from fx_daily
union all select 'macro', zone, count(distinct yr), min(make_date(yr, 1, 1))::timestamp, max(make_date(yr, 1, 1))::timestamp from fx_monthly_zone group by 2""".format(
    deco.FALLBACK_SQL + """, grid as (select unnest(generate_series(make_timestamp(yr, mo, 1, 0, 0, 0), cast(last_day(make_date(yr, mo, 1)) as timestamp)
  + interval 23 hour, interval 1 hour)) as ts from w where coalesce(a, b) is not null)"""))
def forecast_manifest(v):
    t = _tables(v)
    macro = t["macro"].withColumn("ts", F.make_date("year", F.lit(1), F.lit(1)))
    return build_manifest({"calendar": (t["calendar"], "is_holiday", "ts"), "weather": (t["weather"], "region_id", "ts"), "macro": (macro, "region_id", "ts")})


def _full_tables(v):
    """The forecast tables with measured weather for a part of the days, and holidays."""
    cap = v.daily.select(F.col("d").cast("timestamp_ntz").alias("ts"), F.lit("cf").alias("region_id"), (F.col("cf") - 0.3).alias("wind_cf"), F.col("cf").alias("solar_cf"))
    fresh = v.daily.filter("day(d) % 3 = 0").select(F.col("d").cast("timestamp_ntz").alias("ts"), F.when(F.month("d") != 2, F.col("cf") * 7).alias("wind_speed_10m"),
                                                  (F.col("cf") * 20).alias("temperature_2m"))
    macro = v.monthly_zone.groupBy(F.col("yr").alias("year"), F.col("zone").alias("region_id")).agg(F.sum("total").alias("industry_index"))
    days = v.literal([("2024-01-01",), ("2024-01-08",), ("1996-03-08",)], "d string").select(F.col("d").cast("date").alias("d"))
    return demand.build_forecast_tables(v.load_wide, "ts", deco.two_sources(v), ("a", "b"), "KZ_SYSTEM", cap, [macro], fresh_weather=fresh, holidays=days)


@query("p6_weather_refreshed", """
select cast(d as timestamp) as ts, round(case when day(d) % 3 = 0 and month(d) <> 2 then cf * 7 else greatest(cf - 0.3, 0) * 15 end, 6) as wind_speed_10m,
  round(greatest(cf, 0) * 1000, 5) as shortwave_radiation, round(case when day(d) % 3 = 0 then cf * 20 end, 6) as temperature_2m from fx_daily""")
def weather_refreshed(v):
    w = _full_tables(v)["weather"].select("ts", "wind_speed_10m", "shortwave_radiation", "temperature_2m")
    return rounded(rounded(w, 6, "wind_speed_10m", "temperature_2m"), 5, "shortwave_radiation")


_TIMES = deco.FALLBACK_SQL + """, grid as (select unnest(generate_series(make_timestamp(yr, mo, 1, 0, 0, 0), cast(last_day(make_date(yr, mo, 1)) as timestamp)
  + interval 23 hour, interval 1 hour)) as ts from w where coalesce(a, b) is not null)"""


@query("p6_holidays", f"""
with {_TIMES}, c as (select distinct ts from (select ts from fx_hourly union all select ts from grid) a)
select cast(ts as date) in (date '2024-01-01', date '2024-01-08', date '1996-03-08') as holiday, count(*) as n from c group by 1""")
def holidays(v):
    return _full_tables(v)["calendar"].groupBy((F.col("is_holiday") == 1).alias("holiday")).agg(F.count("*").alias("n"))


@query("p6_load_manifest", f"""
with {_TIMES} select 'load' as tbl, 'KZ_SYSTEM' as grp, count(*) as n_rows, min(ts) as first_ts, max(ts) as last_ts from grid
union all select 'load', region_id, count(*), min(ts), max(ts) from fx_hourly group by 2""")
def load_manifest(v):
    return build_manifest({"load": (_full_tables(v)["load"], "region_id", "ts")})


TRANSFER_HORIZONS, MIRROR_HORIZONS = (1, 6, 24, 168), (1, 24, 168)


def _exogenous_load(v):
    """The dense panel with holidays by time, weather by time and region, and an index by year and region."""
    load = v.dense.drop("is_filled")
    e = v.t("events")
    days = v.literal([("2024-01-01",), ("2024-01-02",), ("2024-01-07",)], "d string")
    holidays = calendar.calendar_table(load, "ts", days.select(F.col("d").cast("date").alias("d"))).select("ts", "is_holiday")
    where = [F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("region_id")]
    weather = e.groupBy(*where).agg(F.avg((F.col("user_id") % 15) - 7.0).alias("u100"), F.avg((F.col("user_id") % 11) - 5.0).alias("v100"))
    macro = e.groupBy(F.year("ts").alias("year"), F.col("event_type").alias("region_id")).agg(F.count_distinct("user_id").alias("industry_index"))
    return demand.with_exogenous(load, R, "ts", holidays, weather, macro)


def _transfer_study(v, **options):
    return demand.train_and_evaluate(_exogenous_load(v), R, "ts", "y", _target(), TRANSFER_HORIZONS, exogenous=("is_holiday", "u100", "v100", "industry_index"), dense=True, **options)


def _mirror_study(v, **options):
    return demand.mirror_test(v.dense.drop("is_filled"), R, "ts", "y", _target(), MIRROR_HORIZONS, dense=True, **options)


_SCORED = ("horizon", "region_id", "model", "n", "mae", "rmse", "smape_pct", "picp_pct", "mase", "mase_season")


def _naive_sql(horizons, train, val):
    """Scores of the seasonal naive rows of a study at all horizons."""
    shift = {h: 24 * -(-h // 24) - h for h in horizons}
    ahead = " union all ".join(f"select region_id, i, cnt, y, {h} as horizon, s{h} as snaive, t{h} as target from f" for h in horizons)
    return f"""
with f as (select region_id, y, row_number() over w - 1 as i, count(*) over (partition by region_id) as cnt,
    {", ".join(f"lag(y, {k}) over w as s{h}, lead(y, {h}) over w as t{h}" for h, k in shift.items())}
  from fx_hourly_dense where region_id = 'view' window w as (partition by region_id order by ts)),
e as (select *, case when i - 168 < floor((cnt - 168 - horizon) * {train}::double) then 'train' when i - 168 < floor((cnt - 168 - horizon) * ({train}::double + {val}::double)) then 'val' else 'test' end as split
  from ({ahead}) a where i >= 168 and target is not null),
q as (select horizon, quantile_cont(abs(target - snaive), 0.9) as q from e where split = 'val' group by 1),
s as (select horizon, avg(abs(d)) as scale from (select horizon, y - lag(y, 24) over (partition by horizon order by i) as d from e where split = 'train') z group by 1)
select horizon, region_id, 'seasonal_naive' as model, count(*) as n, round(avg(abs(target - snaive)), 4) as mae, round(sqrt(avg((target - snaive) ** 2)), 4) as rmse,
  round(100 * avg(case when abs(target) + abs(snaive) > 0 then 2 * abs(target - snaive) / (abs(target) + abs(snaive)) end), 4) as smape_pct,
  round(100 * avg(case when abs(target - snaive) <= q then 1.0::double else 0 end), 4) as picp_pct, round(avg(abs(target - snaive)) / max(scale), 4) as mase, 24 as mase_season
from e join q using (horizon) join s using (horizon) where split = 'test' group by 1, 2"""


@query("p7_train_and_evaluate")
def train_and_evaluate(v):
    return rounded(_transfer_study(v)["metrics"], 4)


@query("p7_naive_rows", _naive_sql(TRANSFER_HORIZONS, 0.6, 0.2))
def transfer_naive_rows(v):
    """The rows that every model of the study is scored on, with the seasonal naive forecast."""
    return rounded(_transfer_study(v, learned=False)["metrics"].select(*_SCORED), 4)


@query("p7_seasonal_rows", """
with f as (select region_id, y, lag(y, 168) over w as back, lead(y, 24) over w as target, row_number() over w - 1 as i,
  count(*) over (partition by region_id) as cnt from fx_hourly_dense window w as (partition by region_id order by ts))
select region_id, count(*) as n, round(avg(abs(target - y)), 6) as mae, round(sqrt(avg((target - y) ** 2)), 6) as rmse from f
where i >= floor(cnt * 0.8::double) and target is not null and back is not null group by 1""")
def seasonal_rows(v):
    """The test rows of all regions at one horizon, with the seasonal naive forecast."""
    f = demand.feature_table(v.dense.drop("is_filled"), R, "ts", "y", 24, dense=True).filter("split = 'test'")
    return rounded(f.groupBy(*R).agg(F.count("*").alias("n"), metrics.mae("target", "snaive").alias("mae"), metrics.rmse("target", "snaive").alias("rmse")), 6)


@query("p7_exogenous_rows", """
with w as (select date_trunc('hour', ts) as ts, event_type as region_id, avg((user_id % 15) - 7.0::double) as u100, avg((user_id % 11) - 5.0::double) as v100 from events group by 1, 2),
m as (select year(ts) as year, event_type as region_id, count(distinct user_id) as industry_index from events group by 1, 2)
select d.region_id, d.ts, round(y, 2) as y, case when cast(d.ts as date) in (date '2024-01-01', date '2024-01-02', date '2024-01-07') then 1 else 0 end as is_holiday,
  round(u100, 6) as u100, round(v100, 6) as v100, industry_index
from fx_hourly_dense d left join w on w.ts = d.ts and w.region_id = d.region_id left join m on m.year = year(d.ts) and m.region_id = d.region_id""")
def exogenous_rows(v):
    """The study's input: load with calendar, weather and macro columns."""
    return rounded(rounded(_exogenous_load(v), 2, "y"), 6, "u100", "v100")


@query("p8_mirror_test")
def mirror_test(v):
    return rounded(_mirror_study(v)["metrics"], 4)


@query("p8_naive_rows", _naive_sql(MIRROR_HORIZONS, 0.7, 0.15))
def mirror_naive_rows(v):
    return rounded(_mirror_study(v, learned=False)["metrics"].select(*_SCORED), 4)


def _compare(v, holt, more=None, save_to=None):
    total = v.monthly_zone.select("zone", "yr", "mo", "total")
    if more is not None:
        total = total.unionByName(more.select("zone", "yr", "mo", "total"))
    total = total.withColumn("m", F.make_date("yr", "mo", F.lit(1))).select("zone", "m", "total")
    return demand.walk_forward_compare(total, ["zone"], "m", F.trunc("m", "year"), "total", 3, 12, holt=holt, save_to=save_to, folds=splits.recent_folds("n"))


_P9_SQL = """with recursive ser as (select zone, row_number() over (partition by zone order by yr, mo) - 1 as idx, count(*) over (partition by zone) as n, total as y from fx_monthly_zone),
cut as (select zone, n, s, unnest(range(s, n - 3 + 1)) as cutoff from (select zone, n, greatest(3, n - greatest(2, least(floor(n * 0.4::double), 12))::bigint - 3 + 1) as s
  from (select distinct zone, n from ser) a where n >= 6) b),
""" + _HOLT_ALL.format(k="zone") + """,
tgt as (select zone, n, cutoff, step, cutoff + step - 1 as idx from cut cross join (select unnest(range(1, 4)) as step) st),
p as (select c.zone, c.cutoff, arg_max(y, idx) as last, avg(y) as mean, regr_slope(y, idx) as b, regr_intercept(y, idx) as a from cut c join ser s on s.zone = c.zone and s.idx < c.cutoff group by 1, 2),
j as (select t.zone, t.cutoff, t.step, c.y as y_true, last as persistence, mean, a + p.b * t.idx as trend, s.y as seasonal, hb.l + t.step * hb.b as holt from tgt t join p using (zone, cutoff)
  join hb on hb.zone = t.zone and hb.cutoff = t.cutoff and hb.k = 1 join ser c on c.zone = t.zone and c.idx = t.idx left join ser s on s.zone = t.zone and s.idx = t.idx - 12 * ceil(t.step / 12.0)),
l as (unpivot j on persistence, mean, trend, seasonal, holt into name model value y_pred)"""


@query("p9_walk_forward_compare", _P9_SQL + """,
sc as (select zone, avg(abs(d)) as scale from (select s.zone, y - lag(y) over (partition by s.zone order by idx) as d from ser s join (select zone, max(cutoff) as last from cut group by 1) m
  on m.zone = s.zone and s.idx < m.last) z group by 1)
select zone, model, count(*) as n, round(avg(abs(y_true - y_pred)), 5) as mae, round(sqrt(avg((y_true - y_pred) ** 2)), 3) as rmse,
  round(100 * avg(2 * abs(y_true - y_pred) / (abs(y_true) + abs(y_pred))), 6) as smape_pct, round(avg(abs(y_true - y_pred)) / max(scale), 6) as mase
from l join sc using (zone) group by 1, 2""")
def walk_forward_compare(v):
    return rounded(rounded(_compare(v, True)["metrics"].drop("r2"), 3, "rmse"), 6, "smape_pct", "mase").withColumn("mae", F.round("mae", 5))


@query("p9_fold_plan", """
select zone, n as n_rows, greatest(3, n - greatest(2, least(floor(n * 0.4::double), 12))::bigint - 3 + 1) as first_cutoff,
  greatest(0, n - 3 - greatest(3, n - greatest(2, least(floor(n * 0.4::double), 12))::bigint - 3 + 1) + 1) as n_folds,
  case when n - 3 - greatest(3, n - greatest(2, least(floor(n * 0.4::double), 12))::bigint - 3 + 1) + 1 <= 0 then 'too short for one fold' end as reason
from (select zone, count(*) as n from fx_monthly_zone group by 1 union all select 'SHORT', 4) z""")
def compare_fold_plan(v):
    """Which series of the comparison have folds; one of four months has none and says so."""
    short = v.literal([("SHORT", 1997, m, 1, 10.0 + m) for m in range(1, 5)], "zone string, yr int, mo int, n bigint, total double")
    return _compare(v, True, short)["plan"]


@query("p9_saved_predictions", _P9_SQL + """
select zone, model, count(*) as n, round(sum(y_pred), 2) as total from l group by 1, 2""")
def saved_predictions(v):
    """The predictions as the job writes them: saved once, and again in place of those of the same series."""
    where = f"{checkpoint_folder(v.spark)}/p9-{uuid.uuid4().hex}"
    for _ in range(2):
        _compare(v, True, save_to=where)
    return rounded(v.spark.read.parquet(where).groupBy("zone", "model").agg(F.count("*").alias("n"), F.sum("y_pred").alias("total")), 2)


@query("p9_walk_forward_tests")
def walk_forward_tests(v):
    return rounded(_compare(v, True)["comparison"], 6)


@query("p10_daily_cf_compare")
def daily_cf_compare(v):
    return rounded(demand.daily_cf_compare(v.daily, "d", "cf", 364)["metrics"], 6)


@query("p10_daily_cf_naive", """
with s as (select d, cf, row_number() over (order by d) - 1 as idx, count(*) over () as n from fx_daily),
b as (select arg_max(cf, idx) as persistence, avg(cf) as mean from s where idx < n - 364),
t as (unpivot (select cf, persistence, mean from s, b where idx >= n - 364) on persistence, mean into name model value y_pred)
select model, count(*) as n, round(avg(abs(cf - y_pred)), 6) as mae, round(sqrt(avg((cf - y_pred) ** 2)), 6) as rmse from t group by 1""")
def daily_cf_naive(v):
    """The closed-form rows of the daily comparison, whose other models SQL can't express."""
    m = demand.daily_cf_compare(v.daily, "d", "cf", 364)["predictions"].filter("model in ('persistence', 'mean')")
    return rounded(m.groupBy("model").agg(F.count("*").alias("n"), metrics.mae("y_true", "y_pred").alias("mae"), metrics.rmse("y_true", "y_pred").alias("rmse")), 6)


# --- weather, sites, dashboards, verification ---------------------------------------------------------------

def _gridded(v):
    w = v.weather.withColumns({"lat": 40.0 + F.col("loc") * 3, "lon": 50.0 + F.col("loc") * 8})
    k = ["ts", "lat", "lon"]
    return (w.groupBy(*k).agg(F.avg("u100").alias("u100"), F.avg("v100").alias("v100")),
            w.groupBy(*k).agg(F.avg("t2m_k").alias("t2m_k"), F.avg("d2m_k").alias("d2m_k"), F.avg("ssrd").alias("ssrd")))


@query("p11_weather_to_cf", """
with w as (select ts, 40.0::double + loc * 3 as lat, 50.0::double + loc * 8 as lon, avg(u100) as u, avg(v100) as v, avg(t2m_k) - 273.15 as t,
  greatest(avg(ssrd) / 3600, 0) as ghi from fx_weather group by 1, 2, 3),
pts as (select distinct lat, lon from w),
near as (select * from (select l.label, l.resource, p.lat, p.lon, row_number() over (partition by l.label
  order by (p.lat - l.lat) ** 2 + (p.lon - l.lon) ** 2, p.lat, p.lon) as k from fx_locations l cross join pts p) z where k = 1),
s as (select label, resource, ts, sqrt(u * u + v * v) as ws, t, ghi from w join near using (lat, lon))
select label, resource, ts, round(ws, 6) as ws100, round(ghi, 5) as ghi_wm2,
  round(case when resource = 'wind' then case when ws < 3 then 0 when ws < 12 then pow((ws - 3) / 9, 3) when ws <= 25 then 1 else 0 end end, 7) as cf_wind,
  round(case when resource = 'solar' then least(greatest(ghi / 1000 * (1 - 0.004::double * t), 0), 1) end, 7) as cf_solar from s""")
def weather_to_cf(v):
    out = site.weather_to_cf(*_gridded(v), LOCATIONS).select("label", "resource", "ts", "ws100", "ghi_wm2", "cf_wind", "cf_solar")
    return rounded(rounded(rounded(out, 6, "ws100"), 5, "ghi_wm2"), 7, "cf_wind", "cf_solar")


def _verified(v):
    accept = quality.acceptance(v.balance_long.filter("unit = 'TJ' and yr = 1998"), F.sum("value"), 3_132_269.0, "total")
    return site.verify_all(
        {"fx_balance_long": v.balance_long, "fx_facts": v.facts, "fx_hourly": v.hourly, "load": v.load_wide}, checks.FLOORS,
        checks.parity_frames(v), ["zone", "d"], {"load": ["click_load_actual", "ts"]}, (v.hourly, R, "ts"), [accept],
        (checks.compared_facts(v), ["yr", "metric"]), (checks.audited_facts(v), ["yr", "metric"], "confirmed"), checks.realism_inputs(v))


@query("p12_verification", f"""
with {checks._PARITY_SQL}, par as (select case when s.n is not distinct from t.n and abs(coalesce(s.p, 0) - coalesce(t.p, 0)) < 1 then 'pass' else 'fail' end as severity
  from s full join t on s.zone = t.zone and s.d = t.d),
{checks.CHECKS_SQL}, total as (select severity from every union all select severity from par union all select 'fail' union all
  select case when count(*) > count(ts) then 'fail' else 'pass' end from fx_load_wide union all
  select case status when 'match' then 'pass' when 'differs' then 'fail' else 'warn' end from ({checks.FACT_PARITY_SQL}) fp union all
  select case when confirmed then 'pass' else 'warn' end from ({checks.AUDIT_SQL}) au union all select severity from ({checks.REALISM_SQL}) re)
select case when count(*) filter (severity = 'fail') > 0 then 'FAIL' else 'PASS' end as status, count(*) filter (severity = 'fail') as n_fail,
  count(*) filter (severity = 'warn') as n_warn, count(*) filter (severity = 'pass') as n_pass from total""")
def verification(v):
    return _verified(v)["verdict"]


@query("p13_dashboards", """
with one as (select * from fx_balance_long where unit = 'TJ' and line_item = 'N' and fuel_group <> 'PROMO'),
mix as (select fuel_group, sum(value) as v from one where yr = 1998 group by 1)
select 'overview' as page, 'total by year' as series, cast(yr as varchar) as item, round(sum(value), 2) as value from one group by 3
union all select 'overview', 'kpi latest total', cast(max(yr) as varchar), round(arg_max(v, yr), 2) from (select yr, sum(value) as v from one group by 1) y
union all select 'overview', 'kpi mean total', 'all years', round(avg(v), 2) from (select yr, sum(value) as v from one group by 1) y
union all select 'market', 'month by zone', strftime(d, '%Y-%m') || '/' || zone, round(sum(payment), 2) from fx_market group by 3
union all select 'overview', 'fuel mix pct', fuel_group, round(100 * v / sum(v) over (), 6) from mix
union all select 'demand', 'hour profile', concat_ws('/', zone, hr), round(avg(payment), 6) from fx_market group by 3
union all select 'demand', 'weekday profile', concat_ws('/', zone, isodow(d) - 1), round(avg(payment), 6) from fx_market group by 3
union all select 'generation', 'balance', cast(yr as varchar), round(production - consumption, 2) from fx_prod_cons
union all select 'generation', 'latest production', cast(yr as varchar), round(production, 2) from fx_prod_cons where yr = (select max(yr) from fx_prod_cons)
union all select 'forecast', 'mae', model, round(avg(abs(y_true - y_pred)), 6) from fx_preds group by 3""")
def dashboards(v):
    d = site.dashboard_queries(v.balance_long, v.market, v.prod_cons, v.preds, "TJ", "N", "PROMO", 1998)
    money = F.col("series").isin("total by year", "balance", "latest production", "kpi latest total", "kpi mean total", "month by zone")
    return d.withColumn("value", F.when(money, F.round("value", 2)).otherwise(F.round("value", 6)))


def _study(v):
    return site.site_study(v.sites, "site", deco.WEIGHTS, deco.BENEFIT, res._temps(v), ["loc"], "ts", "t", res.site_cost(v))


@query("p14_site_ranking", f"""
with {deco.TOPSIS_SQL}, t as (select site, capex, mw * 1000 * 8760 * tariff / 1e6 as opex from {res._SITE_COST} c)
select d.site, round(d_minus / (d_plus + d_minus), 8) as closeness, rank() over (order by d_minus / (d_plus + d_minus) desc) as rank,
  round(capex + opex * 10 + 60, 5) as stacked from d join t using (site)""")
def site_ranking(v):
    s = _study(v)
    out = s["ranking"].join(s["tco"], "site").select("site", "closeness", "rank", "stacked")
    return rounded(rounded(out, 8, "closeness"), 5, "stacked")


@query("p14_site_efficiency", res.PUE_SQL)
def site_efficiency(v):
    return rounded(_study(v)["pue"], 8)


def _costed(v):
    cost = res.site_cost(v).withColumn("intensity", 0.3 + F.col("tariff"))
    return site.site_study(v.sites, "site", deco.WEIGHTS, deco.BENEFIT, res._temps(v), ["loc"], "ts", "t", cost)


@query("p14_site_costs", f"""
with o as (select site, mw * 1000 * 8760 as kwh, mw * 1000 * 8760 * tariff / 1e6 as opex, 0.3::double + tariff as intensity from {res._SITE_COST} c)
select site, round(kwh, 2) as kwh, round(opex, 6) as opex, round(100 * (1 - opex / (select max(opex) from o)), 6) as savings_pct, round(intensity * kwh / 1000, 4) as tonnes from o""")
def site_costs(v):
    s = _costed(v)
    return rounded(rounded(rounded(s["opex"].join(s["emissions"], "site"), 2, "kwh"), 6, "opex", "savings_pct"), 4, "tonnes")


@query("p14_tariff_sweep", f"""
select site, round(tariff, 10) as tariff, round(capex + tariff * mw * 1000 * 8760 * 10 / 1e6 + 60, 5) as tco from (
  select site, capex, mw, 0.02::double + i * (0.18::double / 49) as tariff from {res._SITE_COST} s cross join (select unnest(range(0, 50)) as i) x) t""")
def site_tariff_sweep(v):
    return rounded(rounded(_costed(v)["sweep"], 10, "tariff"), 5, "tco")


@query("p14_water", f"""
select site, technology, round(wue * mw * 1000 * 8760, 3) as water_l from {res._SITE_COST} c
cross join (values ('evaporative_tower', 2.0::double), ('hybrid', 0.8), ('air_cooled_chiller', 0.01), ('direct_to_chip', 0.003), ('single_phase_immersion', 0.001)) t(technology, wue)""")
def site_water(v):
    return rounded(_costed(v)["water"], 3, "water_l")


@query("p14_weighted_scores", """
select site, round(s, 4) as score, rank() over (order by s desc) as rank from (
  select site, 0.25::double * demand + 0.25::double * credit + 0.2::double * volume + 0.3::double * cost as s from fx_sites) t""")
def site_scores(v):
    return rounded(_costed(v)["scores"], 4)
