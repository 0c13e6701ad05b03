"""Forecast score and comparison-test queries."""

from pyspark.sql import functions as F

from wattframe.operators import metrics, panel
from wattframe.operators.splits import positional_split
from wattframe.suite.panels import R, dense
from wattframe.suite.registry import query, rounded

E_ABS = "abs(y_true - y_pred)"


@query("e_panel_scores", """
with f as (select region_id, ts, y, lag(y, 168) over w as lag_168, lead(y, 24) over w as target, y as snaive,
    row_number() over w - 1 as i, count(*) over (partition by region_id) as cnt
  from fx_hourly_dense window w as (partition by region_id order by ts)),
s as (select region_id, avg(abs(y - p)) as scale from (select region_id, y, i, cnt, lag(y, 24) over (partition by region_id order by ts) as p from f) a
  where i < floor(cnt * 0.7::double) and p is not null group by 1)
select region_id, count(*) as n, round(avg(abs(target - snaive)), 6) as mae, round(sqrt(avg((target - snaive) ** 2)), 6) as rmse,
  round(100 * avg(case when abs(target) + abs(snaive) > 0 then 2 * abs(target - snaive) / (abs(target) + abs(snaive)) end), 6) as smape_pct,
  round(1 - sum((target - snaive) ** 2) / (var_pop(target) * count(target)), 6) as r2, round(avg(abs(target - snaive)) / max(scale), 6) as mase
from f join s using (region_id) where i >= floor(cnt * (0.7::double + 0.15::double)) and target is not null and lag_168 is not null group by 1""")
def panel_scores(v):
    """Dense panel -> features -> seasonal naive -> per-region time split -> scores."""
    s = positional_split(dense(v), R, "pos", 0.7, 0.15)
    f = panel.feature_panel(s, R, "pos", "y", 24, dense=True)
    test = f.filter("split = 'test' and target is not null and lag_168 is not null")
    scores = metrics.score(test, R, "target", "snaive")
    scale = metrics.mase_scale(s.filter("split = 'train'"), R, "pos", "y", 24, dense=True)
    return rounded(metrics.with_mase(scores, scale, R), 6)


@query("e1_mae", f"select region_id, model, round(avg({E_ABS}), 6) as mae from fx_preds group by 1, 2")
def mae(v):
    return rounded(v.preds.groupBy("region_id", "model").agg(metrics.mae("y_true", "y_pred").alias("mae")), 6)


@query("e2_rmse", "select region_id, model, round(sqrt(avg((y_true - y_pred) ** 2)), 6) as rmse from fx_preds group by 1, 2")
def rmse(v):
    return rounded(v.preds.groupBy("region_id", "model").agg(metrics.rmse("y_true", "y_pred").alias("rmse")), 6)


@query("e3_smape", f"""
select region_id, model, round(100 * avg(case when abs(y_true) + abs(y_pred) > 0 then 2 * {E_ABS} / (abs(y_true) + abs(y_pred)) end), 6) as smape_skip,
  round(100 * avg(2 * {E_ABS} / greatest(abs(y_true) + abs(y_pred), 2e-9::double)), 6) as smape_floor from fx_preds group by 1, 2""")
def smape(v):
    return rounded(v.preds.groupBy("region_id", "model").agg(
        metrics.smape("y_true", "y_pred").alias("smape_skip"), metrics.smape("y_true", "y_pred", 1e-9).alias("smape_floor")), 6)


@query("e4_mase", f"""
with s as (select region_id, avg(abs(y - p)) as scale from (select region_id, ts, y, lag(y, 24) over (partition by region_id order by ts) as p
  from fx_hourly_dense where ts < timestamp '2024-01-22') a where p is not null group by 1)
select region_id, model, round(avg({E_ABS}), 6) as mae, round(avg({E_ABS}) / max(scale), 6) as mase from fx_preds join s using (region_id)
where ts >= timestamp '2024-01-22' group by 1, 2""")
def mase(v):
    cut = F.expr("timestamp_ntz'2024-01-22 00:00:00'")
    scale = metrics.mase_scale(dense(v).filter(F.col("ts") < cut), R, "pos", "y", 24)
    m = v.preds.filter(F.col("ts") >= cut).groupBy("region_id", "model").agg(metrics.mae("y_true", "y_pred").alias("mae"))
    return rounded(metrics.with_mase(m, scale, R), 6)


@query("e5_r2", """
select region_id, model, round(1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(y_true)), 6) as r2 from fx_preds group by 1, 2""")
def r2(v):
    return rounded(v.preds.groupBy("region_id", "model").agg(metrics.r2("y_true", "y_pred").alias("r2")), 6)


@query("e6_pinball", """
select region_id, model, round(avg(greatest(0.05::double * (y_true - y_pred), (0.05::double - 1) * (y_true - y_pred))), 6) as q05,
  round(avg(greatest(0.9::double * (y_true - y_pred), (0.9::double - 1) * (y_true - y_pred))), 6) as q90 from fx_preds group by 1, 2""")
def pinball(v):
    return rounded(v.preds.groupBy("region_id", "model").agg(
        metrics.pinball("y_true", "y_pred", 0.05).alias("q05"), metrics.pinball("y_true", "y_pred", 0.9).alias("q90")), 6)


@query("e7_picp", """
select region_id, model, round(100 * avg(case when y_true between y_pred - 25 and y_pred + 25 then 1.0::double else 0 end), 6) as picp_pct
from fx_preds group by 1, 2""")
def picp(v):
    return rounded(v.preds.groupBy("region_id", "model").agg(
        metrics.picp("y_true", F.col("y_pred") - 25, F.col("y_pred") + 25).alias("picp_pct")), 6)


MODELS = ["mean24", "persistence", "seasonal"]
_PAIRS_SQL = """err as (select region_id, ts, model, y_true - y_pred as e from fx_preds),
p as (select a.region_id, a.ts, a.model as model_a, b.model as model_b, a.e as e_a, b.e as e_b from err a join err b
  on a.region_id = b.region_id and a.ts = b.ts and a.model < b.model),
d as (select *, e_a * e_a - e_b * e_b as d from p)"""
_BASE = "select model_a, model_b, count(*) as n, avg(d) as m, var_samp(d) as v, var_pop(d) as g0 from d group by 1, 2"


def pair_errors(v):
    e = metrics.paired_errors(v.preds, ["region_id", "ts"], "model", "y_true", "y_pred", metrics.all_pairs(MODELS))
    return panel.with_hour_position(e, "ts")


@query("e8_dm_iid", f"""
with {_PAIRS_SQL}, b as ({_BASE})
select model_a, model_b, n, round(m / sqrt(v / n) * sqrt((n + 1 - 2) / n), 6) as dm_stat from b""")
def dm_iid(v):
    return rounded(metrics.diebold_mariano(pair_errors(v), ["model_a", "model_b"], R, "pos", 1, "iid"), 6)


_LAGGED = """l as (select a.model_a, a.model_b, k.k, a.d, b.d as dk from d a cross join (select unnest(range(1, 24)) as k) k
  join d b on a.model_a = b.model_a and a.model_b = b.model_b and a.region_id = b.region_id and b.ts = a.ts - to_hours(k.k))"""
_HLN = "sqrt((n + 1 - 48 + 24 * 23 / n) / n)"


@query("e8_dm_flat", f"""
with {_PAIRS_SQL}, b as ({_BASE}), {_LAGGED},
c as (select model_a, model_b, 2 * sum(c) as x from (select model_a, model_b, k, covar_samp(d, dk) as c from l group by 1, 2, 3) t group by 1, 2)
select model_a, model_b, n, round(m / sqrt(greatest(v + x, 1e-12::double) / n) * {_HLN}, 5) as dm_stat from b join c using (model_a, model_b)""")
def dm_flat(v):
    return rounded(metrics.diebold_mariano(pair_errors(v), ["model_a", "model_b"], R, "pos", 24, "flat"), 5)


@query("e8_dm_bartlett", f"""
with {_PAIRS_SQL}, b as ({_BASE}), {_LAGGED},
c as (select model_a, model_b, 2 * sum((1 - k / 24.0::double) * s) as x from (
  select l.model_a, l.model_b, k, sum((d - m) * (dk - m)) as s from l join b on l.model_a = b.model_a and l.model_b = b.model_b group by 1, 2, 3) t group by 1, 2)
select model_a, model_b, n, round(case when g0 + x / n > 0 then m / sqrt((g0 + x / n) / n) * {_HLN} end, 5) as dm_stat from b join c using (model_a, model_b)""")
def dm_bartlett(v):
    return rounded(metrics.diebold_mariano(pair_errors(v), ["model_a", "model_b"], R, "pos", 24, "bartlett"), 5)


@query("e9_p_values")
def p_values(v):
    dm = metrics.diebold_mariano(pair_errors(v), ["region_id", "model_a", "model_b"], R, "pos", 24, "flat")
    normal = metrics.with_p_value(dm).withColumnRenamed("p_value", "p_normal")
    return rounded(metrics.with_p_value(normal, "t").withColumnRenamed("p_value", "p_student"), 8)


@query("e10_all_pairs", f"""
with {_PAIRS_SQL} select model_a, model_b, region_id, count(*) as n, round(avg(d), 5) as mean_d,
  round(avg(case when abs(e_a) < abs(e_b) then 1.0::double else 0 end), 6) as win_share from d group by 1, 2, 3""")
def all_pairs(v):
    a, b = F.col("e_a"), F.col("e_b")
    return rounded(rounded(pair_errors(v).groupBy("model_a", "model_b", "region_id").agg(
        F.count("*").alias("n"), F.avg(a * a - b * b).alias("mean_d"),
        F.avg(F.when(F.abs(a) < F.abs(b), 1.0).otherwise(0.0)).alias("win_share")), 5, "mean_d"), 6, "win_share")
