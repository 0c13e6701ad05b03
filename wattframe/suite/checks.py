"""Data-quality queries."""

from pyspark.sql import functions as F

from wattframe.functions import clean
from wattframe.operators import metrics, quality, relational as rel
from wattframe.suite.evaluation import pair_errors
from wattframe.suite.panels import R, dense
from wattframe.suite.registry import query, rounded

FLOORS = {"fx_balance_long": 4000, "fx_facts": 15, "fx_hourly": 1000, "absent": 1}
_FLOOR_SQL = " union all ".join(
    f"select 'row_floor' as check_name, '{t}' as item, case when count(*) < {n} then 'fail' else 'pass' end as severity, "
    f"cast(count(*) as varchar) as detail from {t}" for t, n in FLOORS.items() if t != "absent") + (
    " union all select 'row_floor', 'absent', 'fail', '-1'")


def floors(v):
    return quality.row_floors({"fx_balance_long": v.balance_long, "fx_facts": v.facts, "fx_hourly": v.hourly, "absent": None}, FLOORS)


@query("q1_row_floors", _FLOOR_SQL)
def row_floors(v):
    return floors(v)


_PARITY_SQL = """s as (select zone, d, count(*) as n, sum(payment) as p from fx_market group by 1, 2),
t as (select zone, d, count(*) as n, sum(case when direction = 'up' and zone = 'view' then payment + 1 else payment end) as p from fx_market
  where not (zone = 'click' and hr = 3) group by 1, 2)"""


def parity_frames(v):
    bump = F.when((F.col("direction") == "up") & (F.col("zone") == "view"), F.col("payment") + 1).otherwise(F.col("payment"))
    copy = v.market.filter("not (zone = 'click' and hr = 3)").withColumn("payment", bump)
    return quality.slice_parity(v.market, copy, ["zone", "d"], "payment")


@query("q2_slice_parity", f"""
with {_PARITY_SQL} select coalesce(s.zone, t.zone) as zone, coalesce(s.d, t.d) as d, s.n as rows_source, round(s.p, 2) as sum_source, t.n as rows_target,
  round(t.p, 2) as sum_target, round(abs(coalesce(s.p, 0) - coalesce(t.p, 0)), 2) as delta,
  s.n is not distinct from t.n and abs(coalesce(s.p, 0) - coalesce(t.p, 0)) < 1 as ok from s full join t on s.zone = t.zone and s.d = t.d""")
def slice_parity(v):
    return rounded(parity_frames(v), 2)


FACT_PARITY_SQL = """
with a as (select yr, metric, value_bkwh as v from fx_facts), b as (select yr, metric, round(value_bkwh, 1) as v from fx_facts where yr > 1995)
select coalesce(a.yr, b.yr)::int as yr, coalesce(a.metric, b.metric) as metric, round(a.v, 4) as value_a, round(b.v, 4) as value_b,
  case when b.yr is null then 'only_a' when a.yr is null then 'only_b' when abs(a.v - b.v) <= 0.02 then 'match' else 'differs' end as status
from a full join b on a.yr = b.yr and a.metric = b.metric"""


@query("q3_fact_parity", FACT_PARITY_SQL)
def fact_parity(v):
    return rounded(compared_facts(v), 4)


AUDIT_SQL = """
with a as (select yr, metric, value_bkwh as v from fx_facts), b as (select distinct yr, value_bkwh + (yr % 3) * 0.4 as v from fx_facts where metric = 'F')
select yr::int as yr, metric, round(v, 4) as v, exists (select 1 from b where b.yr = a.yr and abs(a.v - b.v) <= 0.5) as confirmed from a"""


@query("q4_tolerance_audit", AUDIT_SQL)
def tolerance_audit(v):
    return rounded(audited_facts(v), 4)


def compared_facts(v):
    f = v.facts.select("yr", "metric", F.col("value_bkwh").alias("v"))
    return rel.parity(f, f.filter("yr > 1995").withColumn("v", F.round("v", 1)), ["yr", "metric"], "v", 0.02)


def audited_facts(v):
    a = v.facts.select("yr", "metric", F.col("value_bkwh").alias("v"))
    b = a.filter("metric = 'F'").withColumn("v", F.col("v") + (F.col("yr") % 3) * 0.4)
    return rel.tolerance_flag(a, b, ["yr"], "v", 0.5, "confirmed")


@query("q5_acceptance_kpi", """
select 'acceptance' as check_name, 'total' as item, 'fail' as severity, round(sum(value), 2) as detail from fx_balance_long
where unit = 'TJ' and yr = 1998""")
def acceptance_kpi(v):
    # the published constant belongs to other data, so the check reports a failure here
    b = v.balance_long.filter("unit = 'TJ' and yr = 1998")
    return quality.acceptance(b, F.sum("value"), 3_132_269.0, "total").select("check_name", "item", "severity",
                                                                              F.col("detail").cast("double").alias("detail"))


def realism_inputs(v):
    cut = F.expr("timestamp_ntz'2024-01-22 00:00:00'")
    scale = metrics.mase_scale(dense(v).filter(F.col("ts") < cut), R, "pos", "y", 24)
    m = metrics.with_mase(metrics.score(v.preds.filter(F.col("ts") >= cut), ["region_id", "model"]), scale, R)
    tests = metrics.with_p_value(metrics.diebold_mariano(pair_errors(v), ["model_a", "model_b"], R, "pos", 1, "iid"))
    return m, tests


REALISM_SQL = """
with s as (select region_id, model, 100 * avg(case when abs(y_true) + abs(y_pred) > 0 then 2 * abs(y_true - y_pred) / (abs(y_true) + abs(y_pred)) end) as smape
  from fx_preds where ts >= timestamp '2024-01-22' group by 1, 2), b as (select count(*) filter (smape <= 0 or smape >= 200) as n from s)
select 'realism' as check_name, 'smape' as item, case when n > 0 then 'fail' else 'pass' end as severity, cast(n as varchar) as detail from b
union all select 'realism', 'mase', 'pass', '0' union all select 'realism', 'comparison', 'pass', '0'"""


@query("q6_metric_realism", REALISM_SQL)
def metric_realism(v):
    return quality.metric_realism(*realism_inputs(v))


@query("q7_null_counts", """
""" + " union all ".join(f"select '{c}' as column_name, count(*) - count({c}) as n_null from fx_load_wide"
                     for c in ("ts", *[f"{k}_load_actual" for k in ("click", "error", "purchase", "signup", "view")])))
def null_counts(v):
    return quality.null_counts(v.load_wide, v.load_wide.columns)


RAW_SQL = """raw as (select event_type as series, case event_id % 50 when 7 then 'bad' when 8 then null else
    case when event_id % 2 = 0 then strftime(date_trunc('hour', ts), '%Y-%m-%d%H:%M:%S') else strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') end end as txt,
  case when event_id % 40 = 3 then null else value end as v, event_id from events),
flagged as (select series, event_id, v, try_cast(regexp_replace(txt, '^([0-9]{4}-[0-9]{2}-[0-9]{2})([0-9]{2}:.*)$', '\\1 \\2') as timestamp) as ts from raw)"""


def raw_series(v):
    k, h = F.col("event_id"), F.date_trunc("hour", "ts")
    txt = (F.when(k % 50 == 7, "bad").when(k % 50 == 8, None).when(k % 2 == 0, F.date_format(h, "yyyy-MM-ddHH:mm:ss"))
           .otherwise(F.date_format(h, "yyyy-MM-dd HH:mm:ss")))
    raw = v.t("events").select(F.col("event_type").alias("series"), "event_id", txt.alias("txt"),
                               F.when(k % 40 != 3, F.col("value")).alias("v"))
    return raw.withColumn("ts", clean.repair_compact_timestamp("txt"))


CLEANING_SQL = f"""with {RAW_SQL},
a as (select series, count(*) as n_before, count(*) filter (v is null) as n_blank, count(*) filter (v is not null and ts is null) as n_bad_time,
  count(*) filter (v is not null and ts is not null) as good, count(distinct ts) filter (v is not null) as n_after,
  min(ts) filter (v is not null) as a, max(ts) filter (v is not null) as z from flagged group by 1)
select series, n_before, n_blank, n_bad_time, good - n_after as n_duplicates, n_after, date_diff('hour', a, z) + 1 - n_after as n_missing_hours from a"""


@query("q8_cleaning_report", CLEANING_SQL)
def cleaning_report(v):
    return quality.cleaning_report(raw_series(v), ["series"], "txt", "ts", ["v"])


COVERAGE_SQL = """select 'rows by yr,unit' as section, concat_ws('/', yr, unit) as item, count(*) as n from fx_balance_long group by 2
union all select 'rows by section', section, count(*) from fx_balance_long group by 2
union all select 'distinct', 'fuel', count(distinct fuel) from fx_balance_long
union all select 'distinct', 'fuel_group', count(distinct fuel_group) from fx_balance_long"""


@query("q9_coverage_report", COVERAGE_SQL)
def coverage_report(v):
    return quality.coverage_report(v.balance_long, [["yr", "unit"], ["section"]], ["fuel", "fuel_group"])


@query("q10_coverage_counts", """
select year(d)::int as year, month(d)::int as month, zone, count(*) as n from fx_market group by 1, 2, 3""")
def coverage_counts(v):
    m = v.market.withColumns({"year": F.year("d"), "month": F.month("d")})
    return quality.coverage_counts(m, ["year", "month", "zone"])


CHECKS_SQL = f"""f as ({_FLOOR_SQL}),
nul as (select 'nulls' as check_name, 'click_load_actual' as item, case when count(*) > count(click_load_actual) then 'fail' else 'pass' end as severity from fx_load_wide),
com as (select case when count(*) filter (n <> 24) > 0 then 'fail' else 'pass' end as severity from (select region_id, cast(ts as date) as d, count(*) as n from fx_hourly group by 1, 2) t),
every as (select severity from f union all select severity from nul union all select severity from com)"""


@query("q11_verdict", f"""
with {CHECKS_SQL} select case when count(*) filter (severity = 'fail') > 0 then 'FAIL' when count(*) filter (severity = 'warn') > 0 then 'PASS WITH WARNINGS' else 'PASS' end as status,
  count(*) filter (severity = 'fail') as n_fail, count(*) filter (severity = 'warn') as n_warn, count(*) filter (severity = 'pass') as n_pass from every""")
def verdict(v):
    return quality.verdict(quality.all_of([floors(v), quality.null_check(v.load_wide, ["click_load_actual"]),
                                           quality.completeness_check(v.hourly, R, "ts")]))
