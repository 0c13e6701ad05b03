"""Weather, efficiency and cost queries."""

from pyspark.sql import functions as F

from wattframe.functions import resource
from wattframe.operators import relational as rel, sites
from wattframe.suite.decompositions import last_year
from wattframe.suite.registry import query, rounded

SPEED = "sqrt(u100 * u100 + v100 * v100)"


@query("k1_wind_speed", f"select ts, loc, round({SPEED}, 8) as ws100 from fx_weather")
def wind_speed(v):
    return rounded(v.weather.select("ts", "loc", resource.wind_speed("u100", "v100").alias("ws100")), 8)


@query("k2_wind_capacity_factor", f"""
select ts, loc, round(case when s < 3 then 0 when s < 12 then pow((s - 3) / 9, 3) when s <= 25 then 1 else 0 end, 8) as cf
from (select ts, loc, 3 * {SPEED} as s from fx_weather) t""")
def wind_cf(v):
    s = 3 * resource.wind_speed("u100", "v100")
    return rounded(v.weather.select("ts", "loc", resource.wind_capacity_factor(s).alias("cf")), 8)


@query("k3_solar_capacity_factor", """
select ts, loc, round(least(greatest(ssrd / 3600 / 1000 * (1 - 0.004::double * (t2m_k - 273.15)), 0), 1), 8) as cf from fx_weather""")
def solar_cf(v):
    ghi = resource.accumulated_to_watts("ssrd")
    return rounded(v.weather.select("ts", "loc", resource.solar_capacity_factor(ghi, resource.kelvin_to_celsius("t2m_k")).alias("cf")), 8)


@query("k4_kelvin_to_celsius", "select ts, loc, round(t2m_k - 273.15, 6) as t2m_c from fx_weather")
def celsius(v):
    return rounded(v.weather.select("ts", "loc", resource.kelvin_to_celsius("t2m_k").alias("t2m_c")), 6)


@query("k5_accumulated_to_watts", """
with h as (select date_trunc('hour', ts) as ts, loc, max(ssrd) as ssrd from fx_weather group by 1, 2)
select ts, loc, round(greatest(ssrd / 3600, 0), 6) as ghi_raw,
  round(greatest((ssrd - coalesce(lag(ssrd) over (partition by loc, cast(ts as date) order by ts), 0)) / 3600, 0), 6) as ghi_step from h""")
def radiation(v):
    h = (v.weather.groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"), "loc").agg(F.max("ssrd").alias("ssrd")))
    d = resource.deaccumulate(h, ["loc"], "ts", "ssrd", "step")
    return rounded(d.select("ts", "loc", resource.accumulated_to_watts("ssrd").alias("ghi_raw"),
                            resource.accumulated_to_watts("step").alias("ghi_step")), 6)


_RH = "100 * exp(17.625::double * d / (243.04::double + d) - 17.625::double * t / (243.04::double + t))"


@query("k6_relative_humidity", f"""
select ts, loc, round({_RH}, 6) as rh_pct from (select ts, loc, t2m_k - 273.15 as t, d2m_k - 273.15 as d from fx_weather) w""")
def humidity(v):
    rh = resource.relative_humidity(resource.kelvin_to_celsius("t2m_k"), resource.kelvin_to_celsius("d2m_k"))
    return rounded(v.weather.select("ts", "loc", rh.alias("rh_pct")), 6)


WEATHER_SQL = f"""select ts, loc, case when loc % 2 = 0 then 'wind' else 'solar' end as resource, round(s, 6) as ws100, round(t, 6) as t2m_c,
  round(ghi, 6) as ghi_wm2, round({_RH}, 6) as rh_pct,
  round(case when loc % 2 = 0 then case when s < 3 then 0 when s < 12 then pow((s - 3) / 9, 3) when s <= 25 then 1 else 0 end end, 8) as cf_wind,
  round(case when loc % 2 = 1 then least(greatest(ghi / 1000 * (1 - 0.004::double * t), 0), 1) end, 8) as cf_solar
from (select ts, loc, {SPEED} as s, t2m_k - 273.15 as t, d2m_k - 273.15 as d, greatest(ssrd / 3600, 0) as ghi from fx_weather) w"""


def weather_bundle(v):
    kind = F.when(F.col("loc") % 2 == 0, "wind").otherwise("solar")
    w = resource.derive_weather(v.weather, kind)
    out = w.select("ts", "loc", "resource", "ws100", "t2m_c", "ghi_wm2", "rh_pct", "cf_wind", "cf_solar")
    return rounded(rounded(out, 6, "ws100", "t2m_c", "ghi_wm2", "rh_pct"), 8, "cf_wind", "cf_solar")


@query("k7_derive_weather", WEATHER_SQL)
def derive_weather(v):
    return weather_bundle(v)


_T = "(select ts, loc, t2m_k - 273.15 + 20 as t from fx_weather)"


def _temps(v):
    return v.weather.select("ts", "loc", (resource.kelvin_to_celsius("t2m_k") + 20).alias("t"))


PUE_SQL = f"""select loc, month(ts)::int as month, round(avg(1 + case when t <= 10 then 0.05::double when t >= 20 then 0.23::double
  else 0.05::double + (t - 10) / 10 * (0.23::double - 0.05::double) end), 8) as pue, count(*) as hours from {_T} w
group by grouping sets ((loc, month(ts)), (loc))"""


@query("k8_pue", PUE_SQL)
def pue(v):
    return rounded(sites.pue_by_month(_temps(v), ["loc"], "ts", "t"), 8)


@query("k9_cooling_hours", f"""
select loc, count(*) filter (t < 10) as free_hours, count(*) filter (t >= 10 and t < 18) as partial_hours, count(*) filter (t >= 18) as mechanical_hours,
  round(100.0::double * count(*) filter (t < 10) / count(t), 6) as free_pct, round(100.0::double * count(*) filter (t >= 10 and t < 18) / count(t), 6) as partial_pct,
  round(100.0::double * count(*) filter (t >= 18) / count(t), 6) as mechanical_pct from {_T} w group by 1""")
def cooling_hours(v):
    return rounded(sites.cooling_hours(_temps(v), ["loc"], "t"), 6)


@query("k9_temperature_bins", f"""
with e(bin, lo, hi) as (values (0, -50.0::double, -20.0::double), (1, -20, -10), (2, -10, 0), (3, 0, 10), (4, 10, 18), (5, 18, 27), (6, 27, 50)),
c as (select e.bin, count(*) as n from {_T} w join e on w.t >= lo and (w.t < hi or (bin = 6 and w.t <= hi)) group by 1)
select e.bin, lo, hi, coalesce(n, 0) as n, round(100.0::double * coalesce(n, 0) / (select sum(n) from c), 6) as pct from e left join c using (bin)""")
def temperature_bins(v):
    return rounded(rel.histogram(_temps(v), "t", resource.TEMPERATURE_EDGES), 6, "pct")


THRESHOLDS = [5, 8, 10, 12, 15, 18, 21, 27]


@query("k10_threshold_sensitivity", f"""
select loc, th::double as threshold, count(*) filter (t < th) as hours_below, round(count(*) filter (t < th)::double / count(*), 8) as share_below
from {_T} w cross join (select unnest([{", ".join(map(str, THRESHOLDS))}]) as th) x group by 1, 2""")
def threshold_sensitivity(v):
    return rounded(sites.threshold_sensitivity(_temps(v), ["loc"], "t", THRESHOLDS), 8, "share_below")


_SITE_COST = "(select site, demand * 0.1::double as mw, 0.02::double + region * 0.02::double as tariff, volume / 1e6 as capex from fx_sites)"


def site_cost(v):
    return v.sites.select("site", (F.col("demand") * 0.1).alias("mw"), (0.02 + F.col("region") * 0.02).alias("tariff"),
                          (F.col("volume") / 1e6).alias("capex"))


@query("k11_energy_opex", f"""
with o as (select site, mw * 1000 * 8760 as kwh, mw * 1000 * 8760 * tariff as opex from {_SITE_COST} s)
select site, round(kwh, 2) as kwh, round(opex, 2) as opex, round(100 * (1 - opex / (select max(opex) from o)), 6) as savings_pct from o""")
def energy_opex(v):
    o = site_cost(v).select("site", resource.annual_energy_kwh("mw").alias("kwh"), resource.annual_opex("mw", "tariff").alias("opex"))
    top = o.agg(F.max("opex"))
    out = o.withColumn("savings_pct", 100 * (1 - F.col("opex") / top.scalar()))
    return rounded(rounded(out, 2, "kwh", "opex"), 6, "savings_pct")


@query("k12_tco", f"""
select site, round(capex + opex * 10 + 60, 6) as stacked, round(capex + (select sum(1 / pow(1.08::double, t)) from (select unnest(range(1, 11)) as t) y) * opex, 6) as npv
from (select site, capex, mw * 1000 * 8760 * tariff / 1e6 as opex from {_SITE_COST} s) o""")
def tco(v):
    opex = resource.annual_opex("mw", "tariff") / 1e6
    return rounded(site_cost(v).select("site", resource.tco_undiscounted(F.col("capex"), opex, F.lit(60.0)).alias("stacked"),
                                       resource.npv_cost(F.col("capex"), opex, 0.08).alias("npv")), 6)


@query("k13_tariff_sweep", f"""
select site, round(tariff, 10) as tariff, round(capex + tariff * mw * 1000 * 8760 * 10 / 1e6 + 60, 5) as tco from (
  select site, capex, mw, 0.02::double + i * (0.18::double / 49) as tariff from {_SITE_COST} s cross join (select unnest(range(0, 50)) as i) x) t""")
def tariff_sweep(v):
    s = sites.tariff_sweep(site_cost(v).drop("tariff"), sites.linspace(0.02, 0.20, 50), {
        "tco": F.col("capex") + F.col("tariff") * resource.annual_energy_kwh("mw") * 10 / 1e6 + 60})
    return rounded(rounded(s.select("site", "tariff", "tco"), 10, "tariff"), 5, "tco")


@query("k14_scope2_emissions", """
select fuel, yr::int as yr, round(c / g / 1e6 * (g * 1000), 4) as tonnes from fx_fuel_emis""")
def scope2(v):
    return rounded(v.fuel_emis.select("fuel", "yr", resource.scope2_emissions(
        F.col("c") / F.col("g") / 1e6, F.col("g") * 1000).alias("tonnes")), 4)


@query("k15_water_use", """
select fuel, technology, round(wue * kwh, 4) as water_l from (select fuel, g * 1000 as kwh from fx_fuel_emis where yr = (select max(yr) from fx_fuel_emis)) f
cross join (values ('evaporative_tower', 2.0::double), ('hybrid', 0.8), ('air_cooled_chiller', 0.01), ('direct_to_chip', 0.003),
  ('single_phase_immersion', 0.001)) t(technology, wue)""")
def water_use(v):
    e = last_year(v).select("fuel", (F.col("g") * 1000).alias("kwh"))
    return rounded(sites.water_by_technology(e, "kwh").select("fuel", "technology", "water_l"), 4)
