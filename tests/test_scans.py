"""Scans and studies that must not depend on chunks, NULL keys or the order of fits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import forecast as fc, learners, metrics, panel, splits
from wattframe.plans import demand


def plain_holt(ys, alpha, beta):
    level, trend, sse = ys[0], ys[1] - ys[0], 0.0
    for y in ys[1:]:
        err = y - level - trend
        sse += err * err
        level, trend = level + trend + alpha * err, trend + alpha * beta * err
    return level, trend, sse


@pytest.mark.parametrize("chunk", [1, 3, 8, 1000])
def test_holt_scan_equals_the_recursion(spark, chunk):
    rng = np.random.default_rng(1)
    series = {"a": rng.normal(size=70).cumsum(), None: rng.normal(size=41).cumsum(), "b": rng.normal(size=5)}
    rows = [(k, i, float(y)) for k, ys in series.items() for i, y in enumerate(ys)]
    cuts = {"a": [3, 8, 9, 24, 64, 65, 70], None: [3, 16, 40], "b": [4]}
    df = spark.createDataFrame(rows, "k string, i bigint, y double")
    cut = spark.createDataFrame([(k, f, c) for k, cs in cuts.items() for f, c in enumerate(cs)], "k string, fold int, cutoff bigint")
    got = fc.holt_states(df, cut, ["k"], "i", "y", [0.2, 0.7], [0.1, 0.9], chunk=chunk).collect()
    assert len(got) == 4 * sum(map(len, cuts.values()))
    for r in got:
        assert (r.level, r.trend, r.sse) == pytest.approx(plain_holt(series[r.k][:r.cutoff], r.alpha, r.beta), rel=1e-9, abs=1e-9)


def test_models_keep_a_series_without_a_key(spark):
    rows = [(k, i, float(np.sin(i / 4) + (0 if k else 3) + 0.01 * (i * 37 % 11))) for k in ("a", None) for i in range(120)]
    df = spark.createDataFrame(rows, "k string, i bigint, y double")
    cut = splits.walk_forward_cutoffs(df.groupBy("k").agg(F.count("*").alias("n")), ["k"], "n", 6, F.lit(3))
    preds = fc.walk_forward(df, cut, splits.fold_targets(cut, ["k"], 6), ["k"], "i", "y", 6, 24, holt=True)
    assert {(r.k, r.model): r.n for r in preds.groupBy("k", "model").agg(F.count("y_pred").alias("n")).collect()} == {
        (k, m): 18 for k in ("a", None) for m in ("persistence", "mean", "trend", "seasonal", "holt")}
    assert {r.k for r in fc.fit_ar_fourier(df, ["k"], "i", "y", 2, 1, 24.0).collect()} == {"a", None}
    hybrid = learners.residual_hybrid(df, ["k"], "i", "y", 1, 24.0, 2, 5, maxDepth=2, maxIter=2)
    assert {r.k: r.n for r in hybrid.groupBy("k").agg(F.count("y_pred").alias("n")).collect()} == {"a": 5, None: 5}


def test_a_series_shorter_than_the_lags_is_reported(spark):
    df = spark.createDataFrame([("a", i, float(i % 4)) for i in range(40)] + [("short", 0, 1.0), ("short", 1, 2.0)], "k string, i bigint, y double")
    got = {(r.k, r.step): r.y_pred for r in learners.lag_gbt(df, ["k"], "i", "y", 4, 3, maxDepth=2, maxIter=2).collect()}
    assert {k for k, v in got.items() if v is None} == {("short", 1), ("short", 2), ("short", 3)} and len(got) == 6


def test_comparison_keeps_its_folds_and_reports_short_series(spark):
    rows = [(k, i, 10.0 + i % 5 + 0.1 * (i * 7 % 3)) for k, n in (("long", 60), (None, 30), ("short", 4)) for i in range(n)]
    df = spark.createDataFrame(rows, "k string, i int, y double")
    got = demand.walk_forward_compare(df, ["k"], "i", F.floor(F.col("i") / 16), "y", 3, 12)
    assert {r.k: (r.n_folds, r.reason) for r in got["plan"].collect()} == {"long": (55, None), None: (25, None), "short": (0, "too short for one fold")}
    assert {r.k: r.n for r in got["metrics"].filter("model = 'holt'").collect()} == {"long": 165, None: 75}
    few = demand.walk_forward_compare(df, ["k"], "i", F.floor(F.col("i") / 16), "y", 3, 12, folds=splits.recent_folds("n"))
    assert {r.k: r.n_folds for r in few["plan"].collect()} == {"long": 12, None: 12, "short": 0}


def test_scale_says_which_season_it_took(spark):
    df = spark.createDataFrame([("a", i, float(i * i)) for i in range(30)] + [("b", i, float(2 * i)) for i in range(20)], "k string, i bigint, y double")
    got = {r.k: (r.mase_season, r.mase_scale) for r in metrics.mase_scale(df, ["k"], "i", "y", 24).collect()}
    assert got["a"] == (24, pytest.approx(np.mean([i * i - (i - 24) ** 2 for i in range(24, 30)]))) and got["b"] == (1, 2.0)


@pytest.fixture(scope="module")
def learnable(spark):
    rng = np.random.default_rng(2)
    data = [(i, float(a), None if i % 11 == 0 else float(b), float(3 * (a > 0) + b + 0.1 * rng.normal())) for i, (a, b) in enumerate(rng.normal(size=(400, 2)))]
    return spark.createDataFrame(data, "id bigint, a double, b double, y double").withColumn("none", F.lit(None).cast("double")).cache()


def test_halving_finds_the_winner_of_the_full_grid(learnable):
    grid = [{"maxDepth": d, "maxIter": 8, "stepSize": s} for d in (1, 3) for s in (0.01, 0.4)]
    parts = learnable.filter("id < 250"), learnable.filter("id >= 250")
    full, _ = learners.tune(*parts, ["a", "b"], "y", grid)
    halved, model = learners.tune(*parts, ["a", "b"], "y", grid, rungs=2)
    best = full.orderBy("rmse").first()
    rows = {r.trial: r for r in halved.collect()}
    assert len(rows) == 4 and sorted(r.rung for r in rows.values()) == [1, 1, 2, 2] and {r.rounds for r in rows.values()} == {4, 8}
    assert rows[best.trial].rung == 2 and rows[best.trial].rmse == pytest.approx(best.rmse)
    assert model.stages[-1].getNumTrees == 8 and model.stages[-1].getMaxDepth() == grid[best.trial]["maxDepth"]


def test_bins_follow_quantiles_and_fill_what_is_missing(learnable):
    got = learners.bin_features(learnable, ["a", "b", "none"], F.col("id") < 300, bins=4).toPandas()
    cuts = got[got.id < 300].a.quantile([0.25, 0.5, 0.75]).to_numpy()
    near = np.abs(got.a.to_numpy()[:, None] - cuts).min(1) > 0.05
    want = (got.a.to_numpy()[:, None] > cuts).sum(1)
    assert (np.array([x[0] for x in got._x])[near] == want[near]).all()
    assert {x[1] for x, b in zip(got._x, got.b, strict=True) if np.isnan(b)} <= {1.0, 2.0} and {x[2] for x in got._x} == {0.0}
    model = learners.fit_binned(learners.bin_features(learnable, ["a", "b"]), "y", maxDepth=3, maxIter=8, stepSize=0.4)
    assert learners.predict_binned(model, learners.bin_features(learnable, ["a", "b"])).agg(metrics.rmse("y", "y_pred")).first()[0] < 0.6


def test_features_of_all_horizons_equal_those_of_one(spark):
    df = spark.createDataFrame([(k, i, float((i * 31) % 17 + (k or 5))) for k in (1, None) for i in range(300)], "k int, i bigint, y double")
    both = panel.horizon_panel(df, ["k"], "i", "y", [1, 24], dense=True)
    for h in (1, 24):
        one = panel.feature_panel(df, ["k"], "i", "y", h, dense=True).filter("target is not null")
        got = panel.at_horizon(both, [1, 24], h).select(*one.columns)
        assert one.count() == 600 - 2 * h and got.exceptAll(one).count() == 0 and one.exceptAll(got).count() == 0


def test_split_by_position_equals_the_numbered_one(spark):
    df = spark.createDataFrame([(k, i) for k, n in (("a", 50), (None, 7)) for i in range(100, 100 + n)], "k string, pos bigint")
    want = splits.chronological_split(df, ["k"], "pos", F.floor(F.col("pos") / 8), 0.6, 0.2)
    got = splits.positional_split(df, ["k"], "pos", 0.6, 0.2).select(*want.columns)
    assert got.exceptAll(want).count() == 0 and got.count() == 57


def test_exogenous_columns_lose_no_row(spark):
    load = spark.sql("select k, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, h) as ts, cast(h as double) as y from (values ('a', 0), ('a', 1), (null, 0), (null, 1)) t(k, h)")
    weather = load.filter("hour(ts) = 0").select("k", "ts", F.lit(5.0).alias("t2m"))
    macro = spark.createDataFrame([(2024, None, 7.0)], "year int, k string, gdp double")
    got = {(r.k, r.y): (r.t2m, r.gdp, r.holiday) for r in demand.with_exogenous(load, ["k"], "ts", load.select("ts", F.lit(1).alias("holiday")).distinct(), weather, macro).collect()}
    assert got == {("a", 0.0): (5.0, None, 1), ("a", 1.0): (None, None, 1), (None, 0.0): (5.0, 7.0, 1), (None, 1.0): (None, 7.0, 1)}


def test_studies_score_all_models_on_the_rows_of_a_horizon(spark):
    hours = spark.range(900).selectExpr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) as ts", "id")
    load = hours.selectExpr("explode(array('x', 'z', null)) as k", "ts", "10 + sin(id / 24 * 6.283) + (id * 7919 % 13) / 10 as y")
    for job, models in ((demand.train_and_evaluate, 4), (demand.mirror_test, 4)):
        got = job(load, ["k"], "ts", "y", F.col("k") == "x", (1, 24, 168), dense=True, maxDepth=2, maxIter=2)
        m = got["metrics"].collect()
        assert len(m) == 3 * models and all(len({r.n for r in m if r.horizon == h}) == 1 and r.mase_season == 24 for h in (1, 24, 168) for r in m)
        assert {r.horizon: r.n for r in m}[168] == 900 - 168 - 168 - int((900 - 336) * (0.8 if job is demand.train_and_evaluate else 0.85))
        assert got["comparison"].count() == 18
