"""Gaps and NULL keys keep their rows, and long series are split for real."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wattframe.joins import on_keys
from wattframe.operators import learners, panel, quantiles, splits
from wattframe.plans import demand


@pytest.fixture(scope="module")
def gappy(spark):
    rows = [(k, i, float(i)) for k in ("a", None) for i in range(40) if i % 7 not in (3, 4, 5)]
    return spark.createDataFrame(rows, "k string, i bigint, y double").cache()


@pytest.mark.parametrize("chunk", [4, 9, 100])
def test_row_lags_do_not_depend_on_where_chunks_end(gappy, chunk):
    w = W.partitionBy("k").orderBy("i")
    want = gappy.select("k", "i", F.lag("y", 3).over(w).alias("v")).toPandas()
    got = panel.over_chunks(gappy, ["k"], "i", lambda x: [F.lag("y", 3).over(x).alias("v")], back=3, chunk=chunk).select("k", "i", "v").toPandas()
    order = [d.assign(k=d.k.fillna("")).sort_values(["k", "i"]).reset_index(drop=True) for d in (got, want)]
    pd.testing.assert_frame_equal(*order)


def test_clock_lag_takes_the_hour_not_the_row(spark):
    df = spark.sql("select k, timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, h) as ts, cast(h as double) as y from "
                   "(values ('a', 0), ('a', 1), ('a', 3), (null, 0), (null, 1)) t(k, h)")
    got = {(r.k, r.y): r.past for r in panel.clock_lag(df, ["k"], "ts", "y", 1, "past").collect()}
    assert got == {("a", 0.0): None, ("a", 1.0): 0.0, ("a", 3.0): None, (None, 0.0): None, (None, 1.0): 0.0}


def test_null_keys_and_times_keep_their_rows(spark):
    df = spark.createDataFrame([("a", 2, 1.0), ("a", None, 2.0), (None, 1, 3.0), (None, 5, 5.0)], "k string, i bigint, y double")
    got = {(r.k, r.i): (r.idx, r.n) for r in panel.with_row_index(df, ["k"], ["i"], F.floor(F.col("i") / 4), total="n").collect()}
    assert got == {("a", None): (0, 2), ("a", 2): (1, 2), (None, 1): (0, 2), (None, 5): (1, 2)}
    q = {r.k: r.m for r in quantiles.quantiles(df, ["k"], "y", {"m": 0.5}).collect()}
    assert q == {"a": 1.5, None: 4.0}
    ranks = {(r.k, r.y): r["rank"] for r in quantiles.with_rank(df, ["k"], "y").collect()}
    assert ranks == {("a", 2.0): 1, ("a", 1.0): 2, (None, 5.0): 1, (None, 3.0): 2}
    z = panel.zscore(df, ["k"], "y").collect()
    assert len(z) == 4 and all(r.z is not None for r in z)
    assert panel.zscore(df, [], "y").count() == 4


def test_joins_on_no_keys_take_the_one_row(spark):
    one = spark.createDataFrame([(7, 8)], "a int, b int")
    assert [tuple(r) for r in on_keys(spark.range(2), one, []).orderBy("id").collect()] == [(0, 7, 8), (1, 7, 8)]


@pytest.mark.parametrize("threshold", ["-1", "10485760"])
def test_chunks_are_dealt_anew_though_the_series_are_together(spark, gappy, threshold):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    try:
        df = panel.over_chunks(gappy.repartition("k"), ["k"], "i", lambda w: [F.lag("y", 1).over(w).alias("v")], back=1, dense=True)
        plan = df._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert any("hashpartitioning(k" in line and "_chunk" in line for line in plan.splitlines() if "Exchange" in line)


def test_folds_have_no_cap_and_short_series_are_reported(spark):
    sizes = spark.createDataFrame([("long", 200), ("short", 20), (None, 40)], "k string, n bigint")
    plan = {r.k: (r.n_folds, r.reason) for r in splits.fold_plan(sizes, ["k"], "n", 24).collect()}
    assert plan == {"long": (174, None), "short": (0, "too short for one fold"), None: (14, None)}
    cuts = splits.walk_forward_cutoffs(sizes, ["k"], "n", 24).groupBy("k").agg(F.count("*").alias("c"), F.min("cutoff").alias("a"), F.max("cutoff").alias("z"))
    assert {(r.k, r.c, r.a, r.z) for r in cuts.collect()} == {("long", 174, 3, 176), (None, 14, 3, 16)}
    equal = splits.rolling_origin_folds(sizes, ["k"], "n", 3, min_rows=30).collect()
    assert sorted((str(r.k), r.fold) for r in equal if r.reason is None) == [("None", 1), ("None", 2), ("None", 3), ("long", 1), ("long", 2), ("long", 3)]
    assert [(r.k, r.fold, r.reason) for r in equal if r.reason] == [("short", None, "too few rows")]


def test_trees_read_out_of_a_model_predict_the_same_and_no_row_is_lost(spark):
    rng = np.random.default_rng(0)
    rows = [(k, float(np.sin(k / 5)), None if k % 9 == 0 else float(k % 7), float(rng.normal())) for k in range(300)]
    df = spark.createDataFrame(rows, "id long, a double, b double, y double")
    model = learners.fit_gbt(df, ["a", "b"], "y", maxDepth=3, maxIter=4)
    got = learners.predict(model, df, ["a", "b"]).toPandas()
    assert len(got) == 300 and got.columns.tolist() == ["id", "a", "b", "y", "y_pred"] and got.b.isna().sum() == 34
    full = got.dropna()
    assert np.abs(learners._tree_sums(learners._tree_arrays(model.stages[-1]), full[["a", "b"]].to_numpy()) - full.y_pred).max() < 1e-12


def test_models_of_a_study_are_scored_on_the_same_rows(spark):
    hours = spark.range(700).selectExpr("timestamp_ntz'2024-01-01' + make_interval(0, 0, 0, 0, cast(id as int)) as ts", "id")
    load = hours.selectExpr("explode(array('x', 'z')) as k", "ts", "10 + sin(id / 24 * 6.283) + (id * 7919 % 13) / 10 as y").filter("not (k = 'z' and hour(ts) = 5)")
    for job in (demand.train_and_evaluate, demand.mirror_test):
        got = demand.over_horizons(job, (1, 24), load, ["k"], "ts", "y", F.col("k") == "x", maxDepth=2, maxIter=2)["metrics"].collect()
        assert len(got) == 8 and {r.horizon for r in got} == {1, 24}
        assert all(len({r.n for r in got if r.horizon == h}) == 1 for h in (1, 24))
