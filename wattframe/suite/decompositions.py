"""Disaggregation, decomposition, break, ranking and projection queries."""

from pyspark.sql import functions as F

from wattframe.operators import decompose, disagg
from wattframe.suite.registry import query, rounded

PROFILE_SQL = """prof as (select month(ts) as month, isodow(ts) - 1 as dow, hour(ts) as hour, avg(y) as weight from fx_hourly
  where isodow(ts) <> 4 or hour(ts) = 5 group by 1, 2, 3)"""
DISAGG_SQL = f"""{PROFILE_SQL},
g as (select zone, yr, mo, total, unnest(generate_series(make_timestamp(yr, mo, 1, 0, 0, 0),
  cast(last_day(make_date(yr, mo, 1)) as timestamp) + interval 23 hour, interval 1 hour)) as ts from fx_monthly_zone),
j as (select g.*, p.weight, hour(g.ts) as h from g left join prof p on p.month = g.mo and p.dow = isodow(g.ts) - 1 and p.hour = hour(g.ts)),
f1 as (select *, coalesce(weight, avg(weight) over (partition by zone, yr, mo, h)) as w1 from j),
f2 as (select *, greatest(coalesce(w1, avg(w1) over (partition by zone, yr, mo), 0), 0) as w2 from f1),
f3 as (select *, sum(w2) over (partition by zone, yr, mo) as sw, count(*) over (partition by zone, yr, mo) as nh from f2),
hourly_load as (select zone, yr, mo, ts, case when sw > 0 then w2 / sw else 1.0::double / nh end * total * 1000 as load_mw from f3)"""


def monthly_to_hourly(v):
    prof = disagg.intraday_profile(v.hourly.filter("weekday(ts) <> 3 or hour(ts) = 5"), "ts", "y")
    return disagg.disaggregate(v.monthly_zone, prof, "total", keys=("zone",))


@query("t1_disaggregate", f"""
with {DISAGG_SQL} select zone, yr::int as yr, mo::int as mo, count(*) as n_hours, round(sum(load_mw) / 1000, 2) as total,
  round(max(load_mw) + 0.001, 2) as peak, round(min(load_mw) + 0.001, 2) as base from hourly_load group by 1, 2, 3""")
def disaggregate(v):
    h = monthly_to_hourly(v)
    return rounded(h.groupBy("zone", "yr", "mo").agg(
        F.count("*").alias("n_hours"), (F.sum("load_mw") / 1000).alias("total"), (F.max("load_mw") + 0.001).alias("peak"),
        (F.min("load_mw") + 0.001).alias("base")), 2)


FALLBACK_SQL = """w as (select yr, mo, sum(total) filter (zone = 'ASIA' and mo % 3 <> 0) as a, sum(total) filter (zone = 'EUROPE' and mo <> 6) as b
  from fx_monthly_zone group by 1, 2), r as (select median(a / b) as ratio from w where a is not null and b is not null)"""


def two_sources(v):
    zone, mo = F.col("zone"), F.col("mo")
    return v.monthly_zone.groupBy("yr", "mo").agg(
        F.sum(F.when((zone == "ASIA") & (mo % 3 != 0), F.col("total"))).alias("a"),
        F.sum(F.when((zone == "EUROPE") & (mo != 6), F.col("total"))).alias("b"))


@query("t2_fallback_source", f"""
with {FALLBACK_SQL} select yr::int as yr, mo::int as mo, round(coalesce(a, b * ratio), 2) as demand,
  case when a is not null then 'primary' else 'scaled' end as source from w, r where coalesce(a, b) is not null""")
def fallback_source(v):
    f = disagg.fallback_source(two_sources(v), "a", "b", "demand", ("primary", "scaled"))
    return rounded(f.select("yr", "mo", "demand", "source"), 2)


@query("t3_proxy_variables", """
select d, round(greatest(cf - 0.3, 0) * 15, 6) as wind_speed_10m, round(greatest(cf, 0) * 1000, 5) as shortwave_radiation,
  cast(null as double) as temperature_2m, cast(null as double) as relative_humidity_2m from fx_daily""")
def proxy_variables(v):
    d = disagg.proxy_variables(v.daily.withColumn("w", F.col("cf") - 0.3), "w", "cf")
    out = d.select("d", "wind_speed_10m", "shortwave_radiation", "temperature_2m", "relative_humidity_2m")
    return rounded(rounded(out, 6, "wind_speed_10m"), 5, "shortwave_radiation")


_LM = "case when abs(c1 - c0) < 1e-15 * greatest(abs(c0), abs(c1)) then c0 else (c1 - c0) / ln(c1 / c0) end"
_LMDI = f"""t as (select fuel, sum(g) filter (yr = 1996) as g0, sum(g) filter (yr = 2000) as g1, sum(c) filter (yr = 1996) as c0,
  sum(c) filter (yr = 2000) as c1 from fx_fuel_emis where yr in (1996, 2000) group by 1),
s as (select *, sum(g0) over () as gt0, sum(g1) over () as gt1, {_LM} as l from t),
e as (select fuel, l * ln(gt1 / gt0) as activity, l * ln((g1 / gt1) / (g0 / gt0)) as structure, l * ln((c1 / g1) / (c0 / g0)) as intensity,
  c1 - c0 as delta from s)"""


@query("x1_lmdi", f"""
with {_LMDI} select fuel, round(activity, 3) as activity, round(structure, 3) as structure, round(intensity, 3) as intensity,
  round(delta, 3) as delta from e""")
def lmdi(v):
    return rounded(decompose.lmdi(v.fuel_emis, "fuel", "yr", "g", "c", 1996, 2000), 3)


@query("x1_lmdi_total", f"""
with {_LMDI} select round(sum(activity), 2) as activity, round(sum(structure), 2) as structure, round(sum(intensity), 2) as intensity,
  round(sum(activity + structure + intensity), 2) as effects, round(sum(delta), 2) as delta from e""")
def lmdi_total(v):
    e = decompose.lmdi(v.fuel_emis, "fuel", "yr", "g", "c", 1996, 2000)
    names = ("activity", "structure", "intensity")
    return rounded(e.agg(*[F.sum(n).alias(n) for n in names], F.sum(sum(F.col(n) for n in names)).alias("effects"),
                         F.sum("delta").alias("delta")), 2)


@query("x2_lmdi_chain", f"""
with t as (select b.yr, a.g as g0, b.g as g1, a.c as c0, b.c as c1 from fx_fuel_emis a join fx_fuel_emis b on a.fuel = b.fuel and b.yr = a.yr + 1),
s as (select *, sum(g0) over (partition by yr) as gt0, sum(g1) over (partition by yr) as gt1, {_LM} as l from t),
e as (select yr, sum(l * ln(gt1 / gt0)) as activity, sum(l * ln((g1 / gt1) / (g0 / gt0))) as structure, sum(l * ln((c1 / g1) / (c0 / g0))) as intensity,
  sum(c1 - c0) as delta from s group by 1)
select yr::int as yr, round(activity, 2) as activity, round(structure, 2) as structure, round(intensity, 2) as intensity, round(delta, 2) as delta,
  round(sum(activity) over w, 2) as cum_activity, round(sum(structure) over w, 2) as cum_structure, round(sum(intensity) over w, 2) as cum_intensity,
  round(sum(delta) over w, 2) as cum_delta from e window w as (order by yr)""")
def lmdi_chain(v):
    return rounded(decompose.lmdi_chain(v.fuel_emis, "fuel", "yr", "g", "c"), 2)


_SUPF = """p as (select {k}tm, y, row_number() over w as k, sum(y) over w as s, count(*) over (partition by {part}) as n,
    sum(y) over (partition by {part}) as st, avg(y) over (partition by {part}) as m from src window w as (partition by {part} order by tm)),
q as (select *, sum((y - m) ** 2) over (partition by {part} order by tm) as q, sum((y - m) ** 2) over (partition by {part}) as q0 from p),
f as (select *, q - (s - k * m) ** 2 / k as l, (q0 - q) - (st - s - (n - k) * m) ** 2 / (n - k) as r from q where k >= 2 and k <= n - 2),
b as (select *, (q0 - l - r) / ((l + r) / (n - 2)) as f from f)
select {k}break_at, n_before, round(f, 4) as sup_f, round(s / n_before, 4) as mean_before, round((st - s) / (n - n_before), 4) as mean_after
from (select *, tm as break_at, k as n_before, row_number() over (partition by {part} order by f desc, k) as pick from b) z where pick = 1"""


@query("x3_sup_f", "with src as (select d as tm, v as y from fx_daily), " + _SUPF.format(k="", part="1"))
def sup_f(v):
    return rounded(decompose.sup_f(v.daily, [], "d", F.trunc("d", "year"), "v"), 4)


@query("x3_sup_f_zones", "with src as (select zone, make_date(yr, mo, 1) as tm, total as y from fx_monthly_zone), " + _SUPF.format(
    k="zone, ", part="zone"))
def sup_f_zones(v):
    m = v.monthly_zone.withColumn("at", F.make_date("yr", "mo", F.lit(1)))
    return rounded(decompose.sup_f(m, ["zone"], "at", F.trunc("at", "year"), "total"), 4)


@query("x4_multi_break", """
with p as (select zone, make_date(yr, mo, 1) as at, total, row_number() over w as k, sum(total) over w as s, sum(total * total) over w as q,
    count(*) over (partition by zone) as n, sum(total) over (partition by zone) as st, sum(total * total) over (partition by zone) as qt
  from fx_monthly_zone window w as (partition by zone order by yr, mo)),
c as (select a.zone, a.k as k1, b.k as k2, a.at as at1, b.at as at2, (a.q - a.s ** 2 / a.k) + (b.q - a.q - (b.s - a.s) ** 2 / (b.k - a.k))
    + (a.qt - b.q - (a.st - b.s) ** 2 / (a.n - b.k)) as ssr
  from p a join p b on a.zone = b.zone and a.k >= 3 and b.k - a.k >= 3 and b.k <= b.n - 3),
r as (select *, row_number() over (partition by zone order by ssr) as i from c)
select zone, 1::int as break_no, k1::int as n_before, at1 as last_period from r where i = 1
union all select zone, 2::int, k2::int, at2 from r where i = 1""")
def multi_break(v):
    m = v.monthly_zone.withColumn("at", F.make_date("yr", "mo", F.lit(1)))
    return decompose.multi_break(m, ["zone"], "at", "total", breaks=2, trim=3)


WEIGHTS = {"demand": 0.25, "credit": 0.25, "volume": 0.2, "cost": 0.3}
BENEFIT = {"demand": True, "credit": True, "volume": True, "cost": False}
TOPSIS_SQL = """m as (unpivot (select site, demand::double as demand, credit, volume, cost from fx_sites) on demand, credit, volume, cost into name criterion value x),
w(criterion, wt, up) as (values ('demand', 0.25::double, true), ('credit', 0.25, true), ('volume', 0.2, true), ('cost', 0.3, false)),
n as (select site, criterion, up, wt * x / sqrt(sum(x * x) over (partition by criterion)) as v from m join w using (criterion)),
i as (select *, case when up then max(v) over p else min(v) over p end as vp, case when up then min(v) over p else max(v) over p end as vm from n
  window p as (partition by criterion)),
d as (select site, sqrt(sum((v - vp) ** 2)) as d_plus, sqrt(sum((v - vm) ** 2)) as d_minus from i group by 1)"""


@query("x5_topsis", f"""
with {TOPSIS_SQL} select site, round(d_plus, 8) as d_plus, round(d_minus, 8) as d_minus, round(d_minus / (d_plus + d_minus), 8) as closeness,
  rank() over (order by d_minus / (d_plus + d_minus) desc) as rank from d""")
def topsis(v):
    m = decompose.to_matrix(v.sites, "site", list(WEIGHTS))
    return rounded(decompose.topsis(m, "site", WEIGHTS, BENEFIT), 8)


@query("x6_weighted_score", """
select site, round(s, 4) as score, rank() over (order by s desc) as rank from (
  select site, 0.5::double * demand + 0.3::double * credit + 0.2::double * cost as s from fx_sites) t""")
def weighted_score(v):
    w = {"demand": 0.5, "credit": 0.3, "cost": 0.2}
    return rounded(decompose.weighted_score(decompose.to_matrix(v.sites, "site", list(w)), "site", w), 4)


SCENARIOS = [("reference", 1.2, 2030), ("transition", 2.0, 2035), ("flat", 1.0, 2028)]
SCENARIO_SQL = """
with s(scenario, f, t) as (values ('reference', 1.2::double, 2030), ('transition', 2.0, 2035), ('flat', 1.0, 2028)),
b as (select fuel, yr, g from fx_fuel_emis where yr = (select max(yr) from fx_fuel_emis)),
p as (select fuel, scenario, yr, g, g * (f - 1) as gap, g * (f - 1) / (t - yr) as need, unnest(range(yr, t + 1)) as year from b cross join s)
select fuel, scenario, year::int as year, round(g + need * (year - yr), 4) as projected, round(gap, 4) as gap, round(need, 6) as annual_need from p"""


def last_year(v):
    latest = v.fuel_emis.agg(F.max("yr"))
    return v.fuel_emis.filter(F.col("yr") == latest.scalar())


@query("x7_scenario_projection", SCENARIO_SQL)
def scenario_projection(v):
    p = decompose.scenario_projection(last_year(v), ["fuel"], "yr", "g", SCENARIOS)
    return rounded(rounded(p, 4, "projected", "gap"), 6, "annual_need")


@query("x8_cagr", """
select fuel, round(pow(arg_max(g, yr) / arg_min(g, yr), 1.0::double / (max(yr) - min(yr))) - 1, 8) as cagr from fx_fuel_emis group by 1""")
def cagr(v):
    e = v.fuel_emis.groupBy("fuel").agg(F.min_by("g", "yr").alias("a"), F.max_by("g", "yr").alias("z"),
                                        (F.max("yr") - F.min("yr")).alias("n"))
    return rounded(e.select("fuel", decompose.cagr(F.col("a"), F.col("z"), F.col("n")).alias("cagr")), 8)
