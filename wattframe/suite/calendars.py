"""Calendar, time-grid, set and split queries."""

from pyspark.sql import functions as F

from wattframe.functions import calendar
from wattframe.operators import panel, splits
from wattframe.session import cut_lineage
from wattframe.suite.panels import R, dense
from wattframe.suite.registry import query, rounded

_DOW = "cast(isodow(ts) - 1 as int)"
def day():
    return F.col("ts").cast("date")



@query("c1_calendar_parts", f"""
select event_id, cast(hour(ts) as int) as hour, {_DOW} as dow, cast(month(ts) as int) as month,
  case when isodow(ts) >= 6 then 1 else 0 end as is_weekend from events""")
def calendar_parts(v):
    return calendar.with_parts(v.t("events").select("event_id", "ts"), "ts", ["hour", "dow", "month", "is_weekend"]).drop("ts")


@query("c2_month_edges", """
select o_orderkey, case when day(o_orderdate) = 1 then 1 else 0 end as is_month_start,
  case when cast(o_orderdate as date) = last_day(o_orderdate) then 1 else 0 end as is_month_end from orders""")
def month_edges(v):
    p = calendar.parts("o_orderdate")
    return v.t("orders").select("o_orderkey", p["is_month_start"].alias("is_month_start"), p["is_month_end"].alias("is_month_end"))


@query("c3_holiday_flag", """
select o_orderkey, case when cast(o_orderdate as date) in (date '1996-03-08', date '1996-03-21', date '1997-12-16', date '1998-01-01')
  then 1 else 0 end as is_holiday from orders""")
def holiday_flag(v):
    days = v.literal([("1996-03-08",), ("1996-03-21",), ("1997-12-16",), ("1998-01-01",)], "d date")
    return calendar.holiday_flag(v.t("orders"), "o_orderdate", days).select("o_orderkey", "is_holiday")


@query("c4_cyclic", """
select event_id, round(sin(2 * pi() * hour(ts) / 24), 8) + 0.0::double as hour_sin, round(cos(2 * pi() * hour(ts) / 24), 8) + 0.0::double as hour_cos,
  round(sin(2 * pi() * dayofyear(ts) / 365.25::double), 8) as doy_sin, round(cos(2 * pi() * dayofyear(ts) / 365.25::double), 8) as doy_cos from events""")
def cyclic(v):
    return rounded(v.t("events").select("event_id", *calendar.cyclic("ts")), 8)


@query("c5_fourier", "select d, " + ", ".join(
    f"round({f}(2 * pi() * {k} * i / 365.25::double), 7) + 0.0::double as {f}_{k}" for k in (1, 2, 3) for f in ("sin", "cos"))
    + " from (select d, row_number() over (order by d) - 1 as i from fx_daily) t")
def fourier(v):
    d = panel.with_row_index(v.daily, [], ["d"], F.trunc("d", "month"))
    return rounded(d.select("d", *calendar.fourier("idx", 365.25, 3)), 7)


@query("c6_time_dimension", "select distinct ts from fx_hourly order by ts")
def time_dimension(v):
    return calendar.time_dimension(v.hourly, "ts").orderBy("ts")


@query("c7_month_hours", """
select yr::int as yr, mo::int as mo, unnest(generate_series(make_timestamp(yr, mo, 1, 0, 0, 0),
  cast(last_day(make_date(yr, mo, 1)) as timestamp) + interval 23 hour, interval 1 hour)) as ts
from (select distinct yr, mo from fx_monthly_zone) m""")
def month_hours(v):
    return calendar.month_hours(v.monthly_zone.select("yr", "mo").distinct(), "yr", "mo")


@query("c8_gap_detection", """
select d.region_id, d.ts from fx_hourly_dense d where d.is_filled = 1""")
def gap_detection(v):
    return panel.missing_steps(v.hourly, R, "ts", "hour")


def gappy(v):
    """Hours of the table without those whose day and hour add up to a multiple of five, or that one region has none of at night."""
    return v.hourly.filter("(day(ts) + hour(ts)) % 5 > 1 and not (region_id = 'click' and hour(ts) < 6)").select("region_id", "ts", "y")


_GAPPY = """g as (select region_id, ts, y from fx_hourly where (day(ts) + hour(ts)) % 5 > 1 and not (region_id = 'click' and hour(ts) < 6)),
e as (select min(ts) as a, max(ts) as z from g), want as (select region_id, unnest(generate_series(a, z, interval 1 hour)) as ts from (select distinct region_id from g) r cross join e),
missing as (select region_id, ts from want anti join g using (region_id, ts))"""


@query("c8_gap_rows", f"with {_GAPPY} select region_id, ts from missing")
def gap_rows(v):
    return panel.missing_steps(gappy(v), R, "ts", "hour")


@query("c8_gap_intervals", f"""
with {_GAPPY}, n as (select *, ts - to_hours(row_number() over (partition by region_id order by ts)) as run from missing)
select region_id, min(ts) as gap_start, max(ts) as gap_end, count(*) as n_missing from n group by region_id, run""")
def gap_intervals(v):
    return panel.gap_intervals(gappy(v), R, "ts", "hour")


@query("c10_gaps_filled", f"""
with {_GAPPY}, al as (select region_id, ts, y from g union all select region_id, ts, null from missing)
select region_id, ts, round(last_value(y ignore nulls) over (partition by region_id order by ts rows between unbounded preceding and current row), 4) as y, y is null as filled from al""")
def gaps_filled(v):
    d = panel.fill_gaps(gappy(v), R, "ts", "hour")
    filled = panel.with_fill_forward(d, R, "ts", day(), "y", "_f")
    return rounded(filled.select("region_id", "ts", F.col("_f").alias("y"), F.col("y").isNull().alias("filled")), 4)


@query("c9_completeness", """
select region_id, cast(ts as date) as d, count(*) as n from fx_hourly group by 1, 2 having count(*) <> 24""")
def completeness(v):
    return v.hourly.groupBy("region_id", day().alias("d")).agg(F.count("*").alias("n")).filter("n <> 24")


@query("c10_gap_fill", """
select region_id, ts, round(last_value(y ignore nulls) over (partition by region_id order by ts
  rows between unbounded preceding and current row), 4) as y, is_filled from (
  select region_id, ts, case when is_filled = 0 then y end as y, is_filled from fx_hourly_dense) t""")
def gap_fill(v):
    d = v.dense.withColumn("y", F.when(F.col("is_filled") == 0, F.col("y")))
    filled = panel.with_fill_forward(d, R, "ts", day(), "y", "filled")
    return rounded(filled.select("region_id", "ts", F.col("filled").alias("y"), "is_filled"), 4)


@query("c11_date_plus_hour", """
select cast(d as timestamp) + to_hours(hr::int) as ts, zone, count(*) as n from fx_market group by 1, 2""")
def date_plus_hour(v):
    return v.market.groupBy(calendar.date_plus_hour("d", "hr").alias("ts"), "zone").agg(F.count("*").alias("n"))


@query("c12_to_utc", "select event_id, ts - interval 5 hour as ts_utc from events")
def to_utc(v):
    # a fixed offset east of Greenwich
    return v.t("events").select("event_id", calendar.to_utc("ts", "+05:00").alias("ts_utc"))


@query("c13_month_start", "select zone, cast(make_date(yr, mo, 1) as timestamp) as month_ts, n from fx_monthly_zone")
def month_start(v):
    return v.monthly_zone.select("zone", calendar.month_start("yr", "mo").alias("month_ts"), "n")


# --- sets, dedup, order, sampling -------------------------------------------------------------------------

@query("u1_union_all", """
select kind, count(*) as n, count(total) as n_total from (
  select 'order' as kind, o_totalprice as total from orders union all select 'line', null from lineitem) t group by 1""")
def union_all(v):
    a = v.t("orders").select(F.lit("order").alias("kind"), F.col("o_totalprice").alias("total"))
    return (splits.union_all(a, v.t("lineitem").select(F.lit("line").alias("kind"))).groupBy("kind")
            .agg(F.count("*").alias("n"), F.count("total").alias("n_total")))


_DEDUP = """select yr::int as yr, unit, line_item, fuel, section, fuel_group, round(value, 2) as value from (
  select *, row_number() over (partition by yr, unit, line_item, fuel order by section {o}, fuel_group {o}) as k from fx_balance_long) t where k = 1"""


@query("u2_dedup_keep_first", _DEDUP.format(o=""))
def dedup_keep_first(v):
    return rounded(splits.keep_first(v.balance_long, ["yr", "unit", "line_item", "fuel"], ["section", "fuel_group"]), 2)


@query("u3_dedup_keep_last", _DEDUP.format(o="desc"))
def dedup_keep_last(v):
    return rounded(splits.keep_last(v.balance_long, ["yr", "unit", "line_item", "fuel"], ["section", "fuel_group"]), 2)


@query("u4_set_difference", """
select distinct ts from fx_hourly_dense where ts not in (select ts from fx_hourly where region_id = 'view')""")
def set_difference(v):
    return splits.set_difference(v.dense, v.hourly.filter("region_id = 'view'"), ["ts"])


@query("u5_order_by", "select region_id, ts, round(y, 2) as y from fx_hourly order by region_id, ts")
def order_by(v):
    return rounded(v.hourly.select("region_id", "ts", "y").orderBy("region_id", "ts"), 2)


@query("u6_capped_sample", """
select o_orderkey, o_totalprice from (select o_orderkey, o_totalprice from orders order by md5(concat(o_orderkey, '|42')), o_orderkey limit 500) t
order by 1""")
def capped_sample(v):
    return splits.capped_sample(v.t("orders").select("o_orderkey", "o_totalprice"), ["o_orderkey"], 500)


_SPLIT = """select {k}{t}, idx, case when idx < floor(cnt * {a}::double) then 'train' when idx < floor(cnt * {b}::double) then 'val' else 'test' end as split
from (select *, row_number() over ({p} order by {t}) - 1 as idx, count(*) over ({p}) as cnt from {src}) s"""


@query("u7_chronological_split", _SPLIT.format(k="", t="d", a=0.6, b=0.8, p="", src="fx_daily"))
def chronological_split(v):
    return splits.chronological_split(v.daily, [], "d", F.trunc("d", "month")).select("d", "idx", "split")


@query("u8_split_per_region", _SPLIT.format(k="region_id, ", t="ts", a=0.7, b="(0.7::double + 0.15::double)", p="partition by region_id", src="fx_hourly"))
def split_per_region(v):
    return (splits.chronological_split(v.hourly, R, "ts", day(), 0.7, 0.15).select("region_id", "ts", "idx", "split"))


@query("u9_date_split", """
select case when d < date '2000-08-01' then 'train' else 'test' end as split, count(*) as n, min(d) as first_d, max(d) as last_d
from fx_daily group by 1""")
def date_split(v):
    return (splits.date_split(v.daily, "d", "2000-08-01").groupBy("split")
            .agg(F.count("*").alias("n"), F.min("d").alias("first_d"), F.max("d").alias("last_d")))


FOLDS_SQL = """cut as (select region_id, n, s, unnest(range(s, n - 24 + 1)) as cutoff from (
    select region_id, n, greatest(3, n - greatest(2, least(floor(n * 0.4::double), 12))::bigint - 24 + 1) as s from (
      select region_id, count(*) as n from fx_hourly_dense group by 1) a where n >= 4) b),
tgt as (select region_id, (cutoff - s)::int as fold, cutoff, step, cutoff + step - 1 as idx from cut cross join (
    select unnest(range(1, 25)) as step) st),
ser as (select region_id, ts, y, row_number() over (partition by region_id order by ts) - 1 as idx from fx_hourly_dense)"""


def fold_frame(v, horizon=24):
    s = cut_lineage(panel.with_row_index(v.dense.drop("is_filled"), R, ["ts"], day()))  # read once per model family
    sizes = s.groupBy("region_id").agg(F.count("*").alias("n"))
    cut = splits.walk_forward_cutoffs(sizes, R, "n", horizon, splits.recent_folds("n"))
    return s, cut, splits.fold_targets(cut, R, horizon)


@query("u10_walk_forward_folds", f"""
with {FOLDS_SQL} select region_id, fold, cutoff, step::int as step, ts, round(y, 4) as y from tgt join ser using (region_id, idx)""")
def walk_forward_folds(v):
    s, _, tgt = fold_frame(v)
    return rounded(tgt.join(s, ["region_id", "idx"]).drop("idx"), 4)


@query("u11_rolling_origin_folds", """
with a as (select region_id, count(*) as n from fx_hourly group by 1)
select region_id, fold::int as fold, n - (5 - fold + 1) * (n // 6) as test_from, n - (5 - fold) * (n // 6) as test_to, cast(null as varchar) as reason
from a cross join (select unnest(range(1, 6)) as fold) f where n >= 500
union all select region_id, null, null, null, 'too few rows' from a where n < 500""")
def rolling_origin_folds(v):
    sizes = v.hourly.groupBy("region_id").agg(F.count("*").alias("n"))
    return splits.rolling_origin_folds(sizes, R, "n", 5, min_rows=500)


@query("u10_all_folds", """
with a as (select event_type, user_id, count(*) as n from events group by 1, 2)
select event_type, user_id, n as n_rows, 3::bigint as first_cutoff, greatest(0, n - 24 - 3 + 1)::bigint as n_folds,
  case when n - 24 - 3 + 1 <= 0 then 'too short for one fold' end as reason from a""")
def all_folds(v):
    sizes = v.t("events").groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return splits.fold_plan(sizes, ["event_type", "user_id"], "n", 24)


@query("u12_merge_train_val", "select region_id, count(*) as n from (" + _SPLIT.format(
    k="region_id, ", t="ts", a=0.6, b=0.8, p="partition by region_id", src="fx_hourly") + ") t where split <> 'test' group by 1")
def merge_train_val(v):
    s = splits.chronological_split(v.hourly, R, "ts", day())
    return splits.merge_train_val(s).groupBy("region_id").agg(F.count("*").alias("n"))
