"""Filter, join and aggregation queries."""

from pyspark.sql import functions as F

from wattframe.functions import calendar
from wattframe.operators import panel, relational as rel
from wattframe.operators.quantiles import cumulative_share, quantiles, with_rank
from wattframe.suite.registry import query, rounded
from wattframe.suite.views import LOCATIONS

# --- filters ----------------------------------------------------------------------------------------------


@query("f1_basic_filters", """
select yr::int as yr, mo::int as mo, zone, n, round(total, 2) as total from fx_monthly_zone
where zone in ('ASIA', 'EUROPE') and yr >= 1996 and yr <= 2000""")
def basic_filters(v):
    m = v.monthly_zone
    return rounded(m.filter(F.col("zone").isin("ASIA", "EUROPE") & F.col("yr").between(1996, 2000)), 2)


@query("f2_condition_text", """
select yr::int as yr, round(sum(value), 2) as total from fx_balance_long
where unit = 'TJ' and line_item = 'R' and fuel_group <> 'PROMO' and section = 'O' group by 1""")
def condition_text(v):
    kept = v.balance_long.filter("unit = 'TJ' and line_item = 'R' and fuel_group <> 'PROMO' and section = 'O'")
    return rounded(kept.groupBy("yr").agg(F.sum("value").alias("total")), 2)


@query("f3_label_match", """
select fuel_group, count(*) as n, round(sum(value), 2) as total from fx_balance_long
where regexp_matches(fuel_group, 'econ|small', 'i') or contains(lower(fuel), 'brand#1') group by 1""")
def label_match(v):
    kept = v.balance_long.filter(F.col("fuel_group").rlike("(?i)econ|small") | F.contains(F.lower("fuel"), F.lit("brand#1")))
    return rounded(kept.groupBy("fuel_group").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query("f4_null_filters", """
select ts, click_load_actual, view_load_actual from (
  select ts, round(click_load_actual, 2) as click_load_actual, round(view_load_actual, 2) as view_load_actual
  from fx_load_wide) w where click_load_actual is not null and view_load_actual is not null""")
def null_filters(v):
    return rounded(v.load_wide.select("ts", "click_load_actual", "view_load_actual")
                   .na.drop(subset=["click_load_actual", "view_load_actual"]), 2)


@query("f5_drop_blank_rows", """
with w as (select event_id, case when user_id % 4 > 0 then value end as a, case when user_id % 3 > 0 then event_type end as b
  from events)
select count(*) as n_before, count(*) filter (a is not null or b is not null) as n_after from w""")
def drop_blank_rows(v):
    w = v.t("events").select("event_id", F.when(F.col("user_id") % 4 > 0, F.col("value")).alias("a"),
                             F.when(F.col("user_id") % 3 > 0, F.col("event_type")).alias("b"))
    before = w.agg(F.count("*").alias("n"))
    return (rel.drop_blank_rows(w, ["event_id"]).agg(F.count("*").alias("n_after"))
            .select(before.scalar().alias("n_before"), "n_after"))


@query("f6_latest_slice", """
select yr::int as yr, metric, round(value_bkwh, 4) as value_bkwh from fx_facts where yr = (select max(yr) from fx_facts)""")
def latest_slice(v):
    return rounded(rel.latest_slice(v.facts.select("yr", "metric", "value_bkwh"), "yr"), 4)


@query("f7_inequality_guard", """
select fuel_group, yr::int as yr, round(value, 2) as value from (
  select fuel_group, yr, sum(value) as value from fx_balance_long where unit = 'TJ' and fuel_group <> 'PROMO' group by 1, 2) t
where value > 100000""")
def inequality_guard(v):
    s = (v.balance_long.filter("unit = 'TJ' and fuel_group <> 'PROMO'").groupBy("fuel_group", "yr")
         .agg(F.sum("value").alias("value")))
    return rounded(s.filter("value > 100000"), 2)


@query("f8_row_slice", """
select region_id, ts, round(y, 2) as y, idx from (
  select region_id, ts, y, row_number() over (partition by region_id order by ts) - 1 as idx from fx_hourly) t
where idx between 100 and 267""")
def row_slice(v):
    h = v.hourly.select("region_id", "ts", "y")
    return rounded(rel.row_slice(h, ["region_id"], "ts", F.col("ts").cast("date"), 100, 168), 2)


# --- joins ------------------------------------------------------------------------------------------------

@query("j1_join_calendar", """
with cal as (select distinct ts, cast(hour(ts) as int) as hour, cast(isodow(ts) - 1 as int) as dow from fx_hourly)
select region_id, ts, round(y, 2) as y, hour, dow from fx_hourly left join cal using (ts)""")
def join_calendar(v):
    cal = calendar.calendar_table(v.hourly, "ts").select("ts", "hour", "dow")
    return rounded(v.hourly.drop("n").join(cal, "ts", "left"), 2)


@query("j2_join_weather", """
with w as (select date_trunc('hour', ts) as ts, event_type as region_id, avg(250.0 + value % 60) as t2m from events
  where user_id % 2 = 0 group by 1, 2)
select region_id, ts, round(y, 2) as y, round(t2m, 6) as t2m from fx_hourly left join w using (ts, region_id)""")
def join_weather(v):
    w = (v.t("events").filter("user_id % 2 = 0")
         .groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), F.col("event_type").alias("region_id"))
         .agg(F.avg(250.0 + F.col("value") % 60).alias("t2m")))
    return rounded(rounded(v.hourly.drop("n").join(w, ["ts", "region_id"], "left"), 2, "y"), 6, "t2m")


@query("j3_join_macro", """
with macro as (select yr, zone, sum(total) / 1e6 as industry_index from fx_monthly_zone where zone <> 'ASIA' group by 1, 2)
select m.yr::int as yr, m.mo::int as mo, m.zone, round(m.total, 2) as total, round(industry_index, 6) as industry_index
from fx_monthly_zone m left join macro using (yr, zone)""")
def join_macro(v):
    macro = (v.monthly_zone.filter("zone <> 'ASIA'").groupBy("yr", "zone")
             .agg((F.sum("total") / 1e6).alias("industry_index")))
    out = v.monthly_zone.select("yr", "mo", "zone", "total").join(macro, ["yr", "zone"], "left")
    return rounded(rounded(out, 2, "total"), 6, "industry_index")


@query("j4_stats_to_detail", """
select region_id, ts, round(y - avg(y) over (partition by region_id), 6) as dev,
  round(stddev_samp(y) over (partition by region_id), 6) as sigma from fx_hourly""")
def stats_to_detail(v):
    d = v.hourly.join(panel.group_stats(v.hourly, ["region_id"], "y"), "region_id")
    return rounded(d.select("region_id", "ts", (F.col("y") - F.col("mu")).alias("dev"), "sigma"), 6)


@query("j5_join_profile", """
with p as (select month(ts) as month, isodow(ts) - 1 as dow, hour(ts) as hour, avg(y) as w from fx_hourly
  where region_id <> 'view' group by 1, 2, 3)
select h.ts, round(h.y, 2) as y, round(p.w, 6) as w from fx_hourly h left join p
  on month(h.ts) = p.month and isodow(h.ts) - 1 = p.dow and hour(h.ts) = p.hour where h.region_id = 'view'""")
def join_profile(v):
    from wattframe.operators.disagg import intraday_profile

    p = intraday_profile(v.hourly.filter("region_id <> 'view'"), "ts", "y")
    h = calendar.with_parts(v.hourly.filter("region_id = 'view'"), "ts", ["month", "dow", "hour"])
    return rounded(rounded(h.join(p, ["month", "dow", "hour"], "left").select("ts", "y", F.col("weight").alias("w")), 2, "y"), 6, "w")


@query("j6_combine_first", """
with fresh as (select region_id, ts, y * 2 as y from fx_hourly where n > 2)
select o.region_id, o.ts, round(coalesce(f.y, o.y), 2) as y from fx_hourly o left join fresh f using (region_id, ts)""")
def combine_first(v):
    fresh = v.hourly.filter("n > 2").withColumn("y", F.col("y") * 2)
    return rounded(rel.combine_first(v.hourly.drop("n"), fresh, ["region_id", "ts"], ["y"]), 2)


@query("j7_parity_join", """
with a as (select yr, metric, sum(value_bkwh) as v from fx_facts where yr <> 1997 group by 1, 2),
b as (select yr, metric, sum(case when yr = 1999 then value_bkwh + 1 else value_bkwh end) as v from fx_facts
  where metric <> 'F' or yr > 1995 group by 1, 2)
select coalesce(a.yr, b.yr)::int as yr, coalesce(a.metric, b.metric) as metric, round(a.v, 4) as value_a,
  round(b.v, 4) as value_b, case when b.yr is null then 'only_a' when a.yr is null then 'only_b'
  when abs(a.v - b.v) <= 0.001 then 'match' else 'differs' end as status
from a full join b on a.yr = b.yr and a.metric = b.metric""")
def parity_join(v):
    f = v.facts.select("yr", "metric", F.col("value_bkwh").alias("v"))
    a = f.filter("yr <> 1997")
    b = (f.filter("metric <> 'F' or yr > 1995")
         .withColumn("v", F.when(F.col("yr") == 1999, F.col("v") + 1).otherwise(F.col("v"))))
    return rounded(rel.parity(a, b, ["yr", "metric"], "v", 0.001), 4)


_TOL_SQL = """
with a as (select o_orderkey, year(o_orderdate) as yr, o_totalprice as v from orders),
b as (select distinct year(l_shipdate) as yr, l_extendedprice as v from lineitem where l_linestatus = 'F')
select {cols} from a where {neg} exists (select 1 from b where b.yr = a.yr and abs(a.v - b.v) <= 0.5)"""


def _tolerance(v):
    a = v.t("orders").select("o_orderkey", F.year("o_orderdate").alias("yr"), F.col("o_totalprice").alias("v"))
    b = (v.t("lineitem").filter("l_linestatus = 'F'")
         .select(F.year("l_shipdate").alias("yr"), F.col("l_extendedprice").alias("v")))
    return rel.tolerance_flag(a, b, ["yr"], "v", 0.5)


@query("j8_tolerance_anti_join", _TOL_SQL.format(cols="o_orderkey, yr::int as yr, v", neg="not"))
def tolerance_anti_join(v):
    return _tolerance(v).filter(~F.col("matched")).drop("matched")


@query("j8_tolerance_semi_join", _TOL_SQL.format(cols="yr::int as yr, count(*) as n", neg="") + " group by 1")
def tolerance_semi_join(v):
    return _tolerance(v).filter("matched").groupBy("yr").agg(F.count("*").alias("n"))


@query("j9_join_grids", """
with a as (select date_trunc('hour', ts) as ts, loc, avg(u100) as u from fx_weather where loc < 3 group by 1, 2),
b as (select date_trunc('hour', ts) as ts, loc, avg(t2m_k) as t from fx_weather where loc > 0 group by 1, 2)
select ts, loc, round(u, 6) as u, round(t, 6) as t from a join b using (ts, loc)""")
def join_grids(v):
    w = v.weather.withColumn("ts", F.date_trunc("hour", "ts").cast("timestamp_ntz"))
    a = w.filter("loc < 3").groupBy("ts", "loc").agg(F.avg("u100").alias("u"))
    b = w.filter("loc > 0").groupBy("ts", "loc").agg(F.avg("t2m_k").alias("t"))
    return rounded(a.join(b, ["ts", "loc"]), 6)


@query("j10_nearest_grid_point", """
select label, lat, lon, round(sqrt(d2), 6) as dist from (
  select l.label, g.lat, g.lon, (g.lat - l.lat) ** 2 + (g.lon - l.lon) ** 2 as d2,
    row_number() over (partition by l.label order by (g.lat - l.lat) ** 2 + (g.lon - l.lon) ** 2, g.lat, g.lon) as k
  from fx_locations l cross join fx_grid g) t where k = 1""")
def nearest_grid_point(v):
    return rounded(rel.nearest_points(v.grid, "lat", "lon", LOCATIONS), 6, "dist")


TAG_SQL = """tagged as (select page, y0, x0, txt, case when regexp_full_match(txt, '20[12][0-9]') then 'YEAR'
  when try_cast(txt as double) between 50 and 200 then 'NUM' end as kind, try_cast(txt as double) as num from fx_tokens)"""
CLUSTER_SQL = TAG_SQL + """, cl as (select *, sum(o) over (partition by page order by y0, x0, num) as cluster from (
  select *, case when abs(y0 - lag(y0) over (partition by page order by y0, x0, num)) >= 6 then 1 else 0 end as o
  from tagged where kind is not null) t)"""


@query("j11_align_token_rows", f"""
with {CLUSTER_SQL},
rows_ as (select page, cluster, first(y0 order by y0, x0) as y, min(y0) filter (kind = 'YEAR') as yy,
  count(*) filter (kind = 'YEAR') as ny, count(*) filter (kind = 'NUM') as nn from cl group by 1, 2),
pairs as (select a.page, a.cluster as ca, b.cluster as cb, row_number() over (partition by a.page, a.cluster
    order by abs(b.y - a.yy), b.cluster) as k
  from rows_ a join rows_ b on a.page = b.page and a.cluster <> b.cluster and a.ny between 3 and 6 and a.nn = 0
    and b.nn >= a.ny - 1 and abs(b.y - a.yy) > 5 and abs(b.y - a.yy) < 120),
yr as (select page, cluster, x0, num, row_number() over (partition by page, cluster order by x0, num) as i from cl where kind = 'YEAR'),
nm as (select page, cluster, x0, num, row_number() over (partition by page, cluster order by x0, num) as i from cl where kind = 'NUM')
select p.page, yr.num::int as year, nm.num as value from pairs p join yr on yr.page = p.page and yr.cluster = p.ca
  join nm on nm.page = p.page and nm.cluster = p.cb and nm.i = yr.i where p.k = 1 and abs(yr.x0 - nm.x0) < 60""")
def align_token_rows(v):
    t = rel.tag_tokens(v.tokens).filter("kind is not null")
    c = panel.gap_clusters(t, ["page"], "y0", "x0", 6.0)
    return rel.align_token_rows(c, "page", "y0", "x0", "cluster")


@query("j12_scenario_sweep", """
select site, round(volume / 1e6 * tariff, 6) as cost, tariff from fx_sites cross join (values (0.5), (1.0), (1.5)) t(tariff0)
  cross join lateral (select tariff0::double as tariff) x""")
def scenario_sweep(v):
    s = rel.sweep(v.sites, "tariff", [0.5, 1.0, 1.5])
    return rounded(s.select("site", (F.col("volume") / 1e6 * F.col("tariff")).alias("cost"), "tariff"), 6)


# --- aggregations -----------------------------------------------------------------------------------------

@query("a1_grouped_sum", """
select yr::int as yr, fuel_group, line_item, round(sum(value), 2) as value from fx_balance_long where unit = 'TJ' group by 1, 2, 3""")
def grouped_sum(v):
    return rounded(v.balance_long.filter("unit = 'TJ'").groupBy("yr", "fuel_group", "line_item")
                   .agg(F.sum("value").alias("value")), 2)


@query("a2_monthly_rollup", """
select cast(year(d) as int) as year, cast(month(d) as int) as month, zone, count(*) as n,
  round(coalesce(sum(case when direction = 'up' then payment end), 0), 2) as up,
  round(coalesce(sum(case when direction = 'down' then payment end), 0), 2) as down,
  round(coalesce(sum(payment), 0), 2) as total from fx_market group by 1, 2, 3""")
def monthly_rollup(v):
    pay, way = F.col("payment"), F.col("direction")
    return rounded(v.market.groupBy(F.year("d").alias("year"), F.month("d").alias("month"), "zone").agg(
        F.count("*").alias("n"), rel.zero_sum(F.when(way == "up", pay)).alias("up"),
        rel.zero_sum(F.when(way == "down", pay)).alias("down"), rel.zero_sum("payment").alias("total")), 2)


@query("a3_year_series", """
select yr::int as yr, round(sum(value), 2) as total from fx_balance_long where unit = 'TJ' and fuel_group <> 'PROMO'
group by 1 order by 1""")
def year_series(v):
    return rounded(v.balance_long.filter("unit = 'TJ' and fuel_group <> 'PROMO'").groupBy("yr")
                   .agg(F.sum("value").alias("total")).orderBy("yr"), 2)


@query("a4_group_having", """
select fuel_group, round(sum(value), 2) as value from fx_balance_long where yr = 1998 and unit = 'TJ' and line_item = 'N'
group by 1 having sum(value) > 0 order by 2 desc""")
def group_having(v):
    return rounded(v.balance_long.filter("yr = 1998 and unit = 'TJ' and line_item = 'N'").groupBy("fuel_group")
                   .agg(F.sum("value").alias("value")).filter("value > 0").orderBy(F.desc("value")), 2)


@query("a5_kpi_cards", """
select yr::int as yr, round(sum(value), 2) as total, round(sum(value) * 1e-6, 8) as total_ej,
  round(sum(value) filter (fuel_group = 'ECONOMY'), 2) as part,
  round(100 * sum(value) filter (fuel_group = 'ECONOMY') / sum(value), 6) as part_pct
from fx_balance_long where unit = 'TJ' group by 1""")
def kpi_cards(v):
    part = F.sum(F.when(F.col("fuel_group") == "ECONOMY", F.col("value")))
    k = v.balance_long.filter("unit = 'TJ'").groupBy("yr").agg(
        F.sum("value").alias("total"), (F.sum("value") * 1e-6).alias("total_ej"), part.alias("part"),
        (100 * part / F.sum("value")).alias("part_pct"))
    return rounded(rounded(rounded(k, 2, "total", "part"), 8, "total_ej"), 6, "part_pct")


@query("a6_share_of_total", """
select fuel, round(g, 2) as g, round(100 * g / sum(g) over (), 6) as share_pct from (
  select fuel, sum(g) as g from fx_fuel_emis group by 1) t""")
def share_of_total(v):
    return rounded(rounded(rel.with_share(v.fuel_emis.groupBy("fuel").agg(F.sum("g").alias("g")), "g"), 2, "g"), 6, "share_pct")


@query("a7_hour_profile", "select zone, hr::int as hr, round(avg(payment) + 1e-9, 6) as mean_payment from fx_market group by 1, 2")
def hour_profile(v):
    return rounded(v.market.groupBy("zone", "hr").agg((F.avg("payment") + 1e-9).alias("mean_payment")), 6)


@query("a8_weekday_profile", """
select zone, cast(isodow(d) - 1 as int) as dow, round(avg(payment) + 1e-9, 6) as mean_payment from fx_market group by 1, 2""")
def weekday_profile(v):
    return rounded(v.market.groupBy("zone", F.weekday("d").alias("dow")).agg((F.avg("payment") + 1e-9).alias("mean_payment")), 6)


# the zones of the market view are the names of the region table
ZONES = ("AFRICA", "AMERICA", "ASIA", "EUROPE", "MIDDLE EAST")


@query("a9_month_zone_pivot", """
select cast(make_date(yr, mo, 1) as timestamp) as month_ts, """ + ", ".join(
    f"round(sum(total) filter (zone = '{z}'), 2) as \"{z}\"" for z in ZONES) + """ from fx_monthly_zone group by 1""")
def month_zone_pivot(v):
    m = v.monthly_zone.withColumn("month_ts", calendar.month_start("yr", "mo"))
    return rounded(m.groupBy("month_ts").pivot("zone", list(ZONES)).agg(F.sum("total")), 2)


@query("a10_daily_mean", """
select region_id, cast(ts as date) as d, round(avg(y), 6) as y, count(*) as n from fx_hourly group by 1, 2""")
def daily_mean(v):
    return rounded(v.hourly.groupBy("region_id", F.col("ts").cast("date").alias("d"))
                   .agg(F.avg("y").alias("y"), F.count("*").alias("n")), 6)


@query("a11_intraday_profile", """
select cast(month(ts) as int) as month, cast(isodow(ts) - 1 as int) as dow, cast(hour(ts) as int) as hour,
  round(avg(y), 6) as weight from fx_hourly group by 1, 2, 3""")
def intraday_profile(v):
    from wattframe.operators.disagg import intraday_profile as profile

    return rounded(profile(v.hourly, "ts", "y"), 6)


@query("a12_hour_backstop", "select cast(hour(ts) as int) as hour, round(avg(y) + 1e-9, 6) as weight from fx_hourly group by 1")
def hour_backstop(v):
    return rounded(v.hourly.groupBy(F.hour("ts").alias("hour")).agg((F.avg("y") + 1e-9).alias("weight")), 6)


@query("a13_group_stats", """
select region_id, round(avg(y), 6) as mu, round(stddev_samp(y), 6) as sigma from fx_hourly group by 1""")
def group_stats(v):
    return rounded(panel.group_stats(v.hourly, ["region_id"], "y"), 6)


@query("a14_median_ratio", """
select round(median(a / b), 8) as ratio, count(*) as n from (select yr, mo, sum(total) filter (zone = 'ASIA') as a,
  sum(total) filter (zone = 'EUROPE') as b from fx_monthly_zone group by 1, 2) t where a is not null and b is not null""")
def median_ratio(v):
    w = v.monthly_zone.groupBy("yr", "mo").pivot("zone", ["ASIA", "EUROPE"]).agg(F.sum("total"))
    return rounded(rel.median_ratio(w, "ASIA", "EUROPE"), 8, "ratio")


@query("a15_abs_residual_quantile", """
select model, round(quantile_cont(abs(y_true - y_pred), 0.9), 6) as q90, count(*) as n from fx_preds group by 1""")
def abs_residual_quantile(v):
    p = v.preds.select("model", F.abs(F.col("y_true") - F.col("y_pred")).alias("e"))
    return rounded(quantiles(p, ["model"], "e", {"q90": 0.9}), 6)


@query("a15_price_quantiles", """
select l_returnflag, count(*) as n, quantile_cont(l_extendedprice, 0.05) as q05, median(l_extendedprice) as q50,
  quantile_cont(l_extendedprice, 0.95) as q95 from lineitem group by 1""")
def price_quantiles(v):
    return quantiles(v.t("lineitem"), ["l_returnflag"], "l_extendedprice", {"q05": 0.05, "q50": 0.5, "q95": 0.95}, stored=True)


@query("a16_distribution_by_unit", """
select unit, count(*) as n, round(min(value), 4) as min, round(median(value), 4) as median, round(max(value), 4) as max
from fx_balance_long group by 1""")
def distribution_by_unit(v):
    b = v.balance_long
    ends = b.groupBy("unit").agg(F.min("value").alias("min"), F.max("value").alias("max"))
    return rounded(quantiles(b, ["unit"], "value", {"median": 0.5}).join(ends, "unit"), 4)


@query("a17_distinct_counts", """
select count(distinct line_item) as line_items, count(distinct fuel) as fuels, count(distinct fuel_group) as groups from fx_balance_long""")
def distinct_counts(v):
    return v.balance_long.agg(F.count_distinct("line_item").alias("line_items"), F.count_distinct("fuel").alias("fuels"),
                              F.count_distinct("fuel_group").alias("groups"))


@query("a18_top_categories", "select fuel, count(*) as n from fx_balance_long group by 1 order by 2 desc, 1 limit 10")
def top_categories(v):
    return rel.top_categories(v.balance_long, "fuel", 10)


_RMSE = "select region_id, model, sqrt(avg((y_true - y_pred) ** 2)) as rmse from fx_preds group by 1, 2"


def _rmse(v):
    e = F.col("y_true") - F.col("y_pred")
    return v.preds.groupBy("region_id", "model").agg(F.sqrt(F.avg(e * e)).alias("rmse"))


@query("a19_best_row", f"""
select region_id, model, round(rmse, 6) as rmse from (select *, row_number() over (partition by region_id order by rmse, model) as k
  from ({_RMSE}) a) b where k = 1""")
def best_row(v):
    return rounded(rel.best_per_group(_rmse(v), ["region_id"], "rmse", "model"), 6)


@query("a20_relative_improvement", f"""
select region_id, model, round(rmse, 6) as rmse, round(100 * (1 - rmse / max(case when model = 'seasonal' then rmse end)
  over (partition by region_id)), 6) as improvement_pct from ({_RMSE}) a""")
def relative_improvement(v):
    return rounded(rel.improvement_vs(_rmse(v), ["region_id"], "model", "rmse", "seasonal"), 6)


@query("a21_balance", """
select yr::int as yr, round(production, 2) as production, round(consumption, 2) as consumption,
  round(production - consumption, 2) as balance,
  case when production > consumption then 'surplus' when production < consumption then 'deficit' else 'even' end as status
from fx_prod_cons""")
def balance(v):
    return rounded(rel.balance(v.prod_cons, "production", "consumption"), 2)


@query("a22_histogram", """
with e(bin, lo, hi) as (values (0, 0.0::double, 10.0::double), (1, 10.0, 25.0), (2, 25.0, 50.0), (3, 50.0, 1000.0)),
c as (select case when y >= 0 and y < 10 then 0 when y >= 10 and y < 25 then 1 when y >= 25 and y < 50 then 2
  when y >= 50 and y <= 1000 then 3 end as bin, count(*) as n from fx_hourly_dense group by 1)
select e.bin, lo, hi, coalesce(n, 0) as n, round(100.0 * coalesce(n, 0) / (select sum(n) from c where bin is not null), 6) as pct
from e left join c using (bin)""")
def histogram(v):
    return rounded(rel.histogram(v.dense, "y", [0, 10, 25, 50, 1000]), 6, "pct")


@query("a23_load_duration", """
select region_id, y, n_equal, k as n_at_or_above, round(k / n, 8) as share_exceeded from (
  select region_id, round(y, 2) as y, count(*) as n_equal, sum(count(*)) over (partition by region_id order by round(y, 2) desc)::bigint as k,
    sum(count(*)) over (partition by region_id) as n from fx_hourly_dense group by 1, 2) t""")
def load_duration(v):
    return rounded(cumulative_share(v.dense.withColumn("y", F.round("y", 2)), ["region_id"], "y"), 8, "share_exceeded")


@query("a24_heat_map", "select zone, " + ", ".join(
    f"round(avg(total) filter (mo = {m}), 4) as \"m{m}\"" for m in range(1, 13)) + " from fx_monthly_zone group by 1")
def heat_map(v):
    w = v.monthly_zone.groupBy("zone").pivot("mo", list(range(1, 13))).agg(F.avg("total"))
    return rounded(w.toDF("zone", *[f"m{m}" for m in range(1, 13)]), 4)


@query("a25_retirement_buckets", """
select bucket::int as bucket, round(total, 2) as total, round(sum(total) over (order by bucket) / sum(total) over (), 8) as cum_share from (
  select floor(yr / 5) * 5 as bucket, sum(production) as total from fx_prod_cons group by 1) t""")
def retirement_buckets(v):
    return rounded(rounded(rel.year_buckets(v.prod_cons, "yr", "production"), 2, "total"), 8, "cum_share")


@query("a26_total_rows", """
select yr::int as yr, coalesce(fuel_group, 'Total') as fuel_group, round(sum(value), 2) as value from fx_balance_long
where unit = 'TJ' group by grouping sets ((yr, fuel_group), (yr))""")
def total_rows(v):
    return rounded(rel.with_total_rows(v.balance_long.filter("unit = 'TJ'"), ["yr"], "fuel_group", "value"), 2)


@query("a27_peer_comparison", """
select site, round(volume / demand, 4) as per_capita, rank() over (order by volume / demand desc) as rank from fx_sites""")
def peer_comparison(v):
    p = v.sites.select("site", (F.col("volume") / F.col("demand")).alias("per_capita"))
    return rounded(with_rank(p, [], "per_capita"), 4)


@query("a28_nearest_row", """
select o_orderkey, o_totalprice from orders order by abs(o_totalprice - 100000), o_orderkey limit 1""")
def nearest_row(v):
    return rel.nearest_row(v.t("orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 100000, "o_orderkey")
