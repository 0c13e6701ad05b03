"""Forecast queries."""

from pyspark.sql import functions as F

from wattframe.operators import forecast as fc, learners, metrics, panel, splits
from wattframe.session import cut_lineage
from wattframe.suite.calendars import FOLDS_SQL, fold_frame
from wattframe.suite.panels import R, dense
from wattframe.suite.registry import query, rounded

H = 24
FEATURES = ["lag_1", "lag_2", "lag_3", "lag_6", "lag_12", "lag_24", "lag_48", "lag_168", "roll_24", "roll_168", "hour", "dow"]
_TRAIN = "tr as (select cut.region_id, (cutoff - s)::int as fold, cutoff, ser.idx, y from cut join ser on cut.region_id = ser.region_id and ser.idx < cutoff)"


def naive(v, models):
    s, cut, tgt = fold_frame(v)
    return fc.naive_forecasts(s, cut, tgt, R, "idx", "y", 24, models).drop("cutoff", "idx", "model")


@query("m1_persistence", f"""
with {FOLDS_SQL}, {_TRAIN}, p as (select region_id, fold, arg_max(y, idx) as y from tr group by 1, 2)
select region_id, fold, step::int as step, round(y, 4) as y_pred from tgt join p using (region_id, fold)""")
def persistence(v):
    return rounded(naive(v, ["persistence"]), 4)


@query("m2_seasonal_naive", f"""
with {FOLDS_SQL} select t.region_id, fold, step::int as step, round(y, 4) as y_pred from tgt t join ser s
  on s.region_id = t.region_id and s.idx = t.idx - 24 * ceil(step / 24.0)""")
def seasonal_naive(v):
    return rounded(naive(v, ["seasonal"]), 4)


@query("m3_mean_train", f"""
with {FOLDS_SQL}, {_TRAIN}, p as (select region_id, fold, avg(y) as y from tr group by 1, 2)
select region_id, fold, step::int as step, round(y, 6) as y_pred from tgt join p using (region_id, fold)""")
def mean_train(v):
    return rounded(naive(v, ["mean"]), 6)


@query("m4_linear_trend", f"""
with {FOLDS_SQL}, {_TRAIN}, p as (select region_id, fold, regr_slope(y, idx) as b, regr_intercept(y, idx) as a from tr group by 1, 2)
select region_id, fold, step::int as step, round(a + b * idx, 6) as y_pred from tgt join p using (region_id, fold)""")
def linear_trend(v):
    return rounded(naive(v, ["trend"]), 6)


def _holt_frame(v):
    s = cut_lineage(panel.with_row_index(v.dense, R, ["ts"], F.col("ts").cast("date")))
    return s, fc.single_cutoff(s, R, F.floor(F.count("*") * F.lit(0.8)))


_HOLT = """s as (select region_id, y, row_number() over (partition by region_id order by ts) - 1 as i, count(*) over (partition by region_id) as n from fx_hourly_dense),
  g as (select a / 10.0::double as alpha, b / 10.0::double as beta from (select unnest({a}) as a) x cross join (select unnest({b}) as b) y),
  h as (select s0.region_id, alpha, beta, s0.n, 0::bigint as i, s0.y as l, s1.y - s0.y as b, 0.0::double as sse
    from s s0 join s s1 on s0.region_id = s1.region_id and s0.i = 0 and s1.i = 1 cross join g
    union all select h.region_id, alpha, beta, h.n, h.i + 1, alpha * s.y + (1 - alpha) * (h.l + h.b),
      beta * (alpha * s.y + (1 - alpha) * (h.l + h.b) - h.l) + (1 - beta) * h.b, h.sse + (s.y - h.l - h.b) ** 2
    from h join s on s.region_id = h.region_id and s.i = h.i + 1 where h.i + 1 < floor(h.n * 0.8::double))"""


@query("m5_holt_fixed", "with recursive " + _HOLT.format(a="[3]", b="[1]") + """
select region_id, round(l, 5) as level, round(b, 5) as trend, round(sse, 2) as sse from h where i + 1 = floor(n * 0.8::double)""")
def holt_fixed(v):
    s, cut = _holt_frame(v)
    st = fc.holt_states(s, cut, R, "idx", "y", [0.3], [0.1], chunk=100)
    return rounded(rounded(st.select("region_id", "level", "trend", "sse"), 5, "level", "trend"), 2, "sse")


@query("m5_holt_search", "with recursive " + _HOLT.format(a="range(1, 10)", b="range(1, 10)") + """,
p as (select *, row_number() over (partition by region_id order by round(sse, 6), alpha, beta) as k from h where i + 1 = floor(n * 0.8::double))
select region_id, alpha, beta, st::int as step, round(l + st * b, 5) as y_pred from p cross join (select unnest(range(1, 25)) as st) t where k = 1""")
def holt_search(v):
    s, cut = _holt_frame(v)
    best = fc.holt_search(fc.holt_states(s, cut, R, "idx", "y"), R)
    f = fc.holt_forecast(best, R, H).join(best.select("region_id", "alpha", "beta"), "region_id")
    return rounded(f.select("region_id", "alpha", "beta", "step", "y_pred"), 5, "y_pred")


def train_rows(v, share=0.8):
    """Rows of the leading share of each series, numbered from 0."""
    s = cut_lineage(panel.with_row_index(v.dense.drop("is_filled"), R, ["ts"], F.col("ts").cast("date"), total="n_rows"))
    return s, s.filter(F.col("idx") < F.floor(F.col("n_rows") * F.lit(share)))


@query("m6_ar_fourier")
def ar_fourier(v):
    _, train = train_rows(v)
    fit = fc.fit_ar_fourier(train, R, "idx", "y", 3, 2, 24.0)
    return rounded(fc.ar_fourier_forecast(fit, R, H, 3, 2, 24.0).select("region_id", "step", "idx", "y_pred"), 6)


@query("m7_lag_gbt")
def lag_gbt(v):
    _, train = train_rows(v)
    return rounded(learners.lag_gbt(train, R, "idx", "y", 2, H).select("region_id", "step", "idx", "y_pred"), 6)


def feature_rows(v, horizon=H):
    """Features, target and split label of the panel; 'view' is the target region, the rest are sources."""
    from wattframe.functions.calendar import with_parts

    s = splits.chronological_split(dense(v), R, "ts", F.col("ts").cast("date"))
    f = panel.feature_panel(s, R, "pos", "y", horizon, dense=True)
    return cut_lineage(with_parts(f, "ts", ["hour", "dow"]).filter("target is not null and lag_168 is not null").drop("is_filled"))


def transfer_frames(v, horizon=H):
    f = feature_rows(v, horizon)
    own = f.filter("region_id = 'view'")
    source = f.filter("region_id <> 'view' and split in ('train', 'val')")
    return source, own.filter("split = 'train'"), own.filter("split = 'val'"), own.filter("split = 'test'")


def _scores(preds, name):
    return rounded(metrics.score(preds, ["region_id"], "target", "y_pred").withColumn("model", F.lit(name)), 4)


@query("m8_direct_gbt")
def direct_gbt(v):
    _, train, _, test = transfer_frames(v)
    return _scores(learners.direct(train, test, FEATURES, "target"), "direct")


@query("m9_pooled_transfer")
def pooled_transfer(v):
    source, train, _, test = transfer_frames(v)
    return _scores(learners.pooled_transfer(source, train, test, FEATURES, "target"), "pooled")


@query("m10_residual_transfer")
def residual_transfer(v):
    source, train, _, test = transfer_frames(v)
    return _scores(learners.residual_transfer(source, train, test, FEATURES, "target"), "residual")


@query("m11_zero_shot")
def zero_shot(v):
    source, _, _, test = transfer_frames(v)
    return _scores(learners.zero_shot(source, test, FEATURES, "target"), "zero_shot")


@query("m12_residual_hybrid")
def residual_hybrid(v):
    _, train = train_rows(v)
    return rounded(learners.residual_hybrid(train, R, "idx", "y", 2, 24.0, 2, H).select("region_id", "step", "idx", "y_pred"), 6)


@query("m13_rolling_origin_backtest")
def rolling_origin_backtest(v):
    f = feature_rows(v)
    sizes = f.groupBy("region_id").agg(F.count("*").alias("n"))
    folds = splits.rolling_origin_folds(sizes, R, "n", 3)
    numbered = panel.with_row_index(f, R, ["ts"], F.col("ts").cast("date"), index="row_no")
    return rounded(learners.rolling_origin(numbered, folds, R, 3, "row_no", FEATURES, "target"), 4)


# every state of the smoothing for all parameter pairs; a cut-off reads the one before it and takes the pair with the least squared error
_HOLT_ALL = """g as (select a / 10.0::double as alpha, b / 10.0::double as beta from (select unnest(range(1, 10)) as a) x cross join (select unnest(range(1, 10)) as b) y),
h as (select s0.{k}, alpha, beta, 0::bigint as i, s0.y as l, s1.y - s0.y as b, 0.0::double as sse
    from ser s0 join ser s1 on s0.{k} = s1.{k} and s0.idx = 0 and s1.idx = 1 cross join g
  union all select h.{k}, alpha, beta, h.i + 1, alpha * s.y + (1 - alpha) * (h.l + h.b),
    beta * (alpha * s.y + (1 - alpha) * (h.l + h.b) - h.l) + (1 - beta) * h.b, h.sse + (s.y - h.l - h.b) ** 2
  from h join ser s on s.{k} = h.{k} and s.idx = h.i + 1),
hb as (select c.{k}, c.cutoff, l, b, row_number() over (partition by c.{k}, c.cutoff order by round(sse, 6), alpha, beta) as k
  from cut c join h on h.{k} = c.{k} and h.i + 1 = c.cutoff)"""


@query("m14_walk_forward", f"""
with recursive {FOLDS_SQL}, {_TRAIN}, {_HOLT_ALL.format(k="region_id")},
p as (select region_id, fold, arg_max(y, idx) as last, avg(y) as mean, regr_slope(y, idx) as b, regr_intercept(y, idx) as a from tr group by 1, 2),
j as (select t.region_id, t.fold, t.step, c.y as y_true, last, mean, a + p.b * t.idx as trend, s.y as seasonal, hb.l + t.step * hb.b as holt from tgt t join p using (region_id, fold)
  join ser c on c.region_id = t.region_id and c.idx = t.idx join hb on hb.region_id = t.region_id and hb.cutoff = t.idx - t.step + 1 and hb.k = 1
  left join ser s on s.region_id = t.region_id and s.idx = t.idx - 24 * ceil(t.step / 24.0)),
l as (unpivot j on last, mean, trend, seasonal, holt into name m value y_pred)
select case m when 'last' then 'persistence' else m end as model, region_id, count(*) as n, count(distinct fold) as n_folds,
  round(avg(abs(y_true - y_pred)), 5) as mae, round(sqrt(avg((y_true - y_pred) ** 2)), 5) as rmse from l group by 1, 2""")
def walk_forward(v):
    s, cut, tgt = fold_frame(v)
    p = fc.walk_forward(s, cut, tgt, R, "idx", "y", H, holt=True)
    return rounded(p.groupBy("model", "region_id").agg(
        F.count("*").alias("n"), F.count_distinct("fold").alias("n_folds"), metrics.mae("y_true", "y_pred").alias("mae"),
        metrics.rmse("y_true", "y_pred").alias("rmse")), 5)


@query("m15_tune")
def tune(v):
    _, train, val, _ = transfer_frames(v)
    grid = [{"maxDepth": d, "stepSize": s} for d in (2, 3, 4) for s in (0.1, 0.3)]
    table, _ = learners.tune(train, val, FEATURES, "target", grid, rungs=2)
    return rounded(table, 4)


@query("m16_feature_importance")
def feature_importance(v):
    _, train, _, test = transfer_frames(v)
    model = learners.fit_gbt(train, FEATURES, "target")
    return rounded(learners.feature_importance(model, test, FEATURES, "target", ["region_id", "ts"]), 6)


@query("m16_row_contributions")
def row_contributions(v):
    """What each feature adds to the forecast of each test row."""
    _, train, _, test = transfer_frames(v)
    return rounded(learners.contributions(learners.fit_gbt(train, FEATURES, "target"), test, FEATURES, ["region_id", "ts"]), 8)


def _halves(v):
    cut = F.expr("timestamp_ntz'2024-01-20 00:00:00'")
    p = v.preds
    return p.filter(F.col("ts") < cut), p.filter(F.col("ts") >= cut)


_HALF = "val as (select * from fx_preds where ts < timestamp '2024-01-20'), test as (select * from fx_preds where ts >= timestamp '2024-01-20')"


@query("m17_conformal_band", f"""
with {_HALF}, q as (select region_id, model, quantile_cont(abs(y_true - y_pred), 0.9) as q from val group by 1, 2)
select region_id, model, ts, round(y_pred - q, 6) as lo, round(y_pred + q, 6) as hi from test join q using (region_id, model)""")
def conformal_band(v):
    val, test = _halves(v)
    b = fc.conformal_band(val, test, ["region_id", "model"])
    return rounded(b.select("region_id", "model", "ts", "lo", "hi"), 6)


@query("m17_conformal_finite_sample", f"""
with {_HALF}, e as (select model, abs(y_true - y_pred) as e, row_number() over (partition by model order by abs(y_true - y_pred)) as k,
  count(*) over (partition by model) as n from val), q as (select model, max(e) as q from e where k = least(ceil((n + 1) * 0.9::double), n) group by 1)
select model, round(max(q), 6) as q, round(100 * avg(case when abs(y_true - y_pred) <= q + 1e-9 then 1.0::double else 0 end), 6) as picp_pct from test join q using (model) group by 1""")
def conformal_finite_sample(v):
    val, test = _halves(v)
    b = fc.conformal_band(val, test, ["model"], finite_sample=True)
    inside = F.when(F.abs(F.col("y_true") - F.col("y_pred")) <= F.col("hi") - F.col("y_pred") + 1e-9, 1.0).otherwise(0.0)
    return rounded(b.groupBy("model").agg(F.max(F.col("hi") - F.col("y_pred")).alias("q"), (100 * F.avg(inside)).alias("picp_pct")), 6)


@query("m18_gaussian_band", f"""
with {_HALF}, s as (select model, stddev_pop(y_true - y_pred) as s from val group by 1)
select region_id, model, ts, round(y_pred - 1.645::double * s, 5) as lo, round(y_pred + 1.645::double * s, 5) as hi from test join s using (model)""")
def gaussian_band(v):
    val, test = _halves(v)
    return rounded(fc.gaussian_band(val, test, ["model"]).select("region_id", "model", "ts", "lo", "hi"), 5)


@query("m19_comparison_table", """
select case when region_id in ('view', 'click') then 'web' else 'ops' end as target, model, count(*) as n,
  round(avg(abs(y_true - y_pred)), 6) as mae, round(sqrt(avg((y_true - y_pred) ** 2)), 6) as rmse from fx_preds group by 1, 2 order by 1, 5""")
def comparison_table(v):
    web = F.col("region_id").isin("view", "click")
    parts = {"web": metrics.score(v.preds.filter(web), ["model"]), "ops": metrics.score(v.preds.filter(~web), ["model"])}
    t = fc.comparison_table(parts, ["target", "rmse"])
    return rounded(t.select("target", "model", "n", "mae", "rmse"), 6)
