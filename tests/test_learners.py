"""Tree forecasts: shapes and that they learn what is there."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import learners, metrics

SMALL = {"maxDepth": 3, "maxIter": 5, "stepSize": 0.5}


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(0)
    data = [(i, float(a), float(b), float(3 * (a > 0) + 0.1 * rng.normal())) for i, (a, b) in enumerate(rng.normal(size=(240, 2)))]
    return spark.createDataFrame(data, "id bigint, a double, b double, y double").cache()


def test_transfer_variants_learn(rows):
    train, test, source = rows.filter("id < 80"), rows.filter("id >= 160"), rows.filter("id between 80 and 159")
    for preds in (learners.direct(train, test, ["a", "b"], "y", **SMALL), learners.residual_transfer(source, train, test, ["a", "b"], "y", **SMALL),
                  learners.pooled_transfer(source, train, test, ["a", "b"], "y", **SMALL)):
        assert preds.count() == 80 and preds.agg(metrics.rmse("y", "y_pred")).first()[0] < 0.9


def test_importance_finds_the_feature(rows):
    model = learners.fit_gbt(rows, ["a", "b"], "y", **SMALL)
    imp = {r["feature"]: r for r in learners.feature_importance(model, rows, ["a", "b"], "y", ["id"]).collect()}
    assert imp["a"]["impurity"] > imp["b"]["impurity"] and imp["a"]["rmse_rise"] > 1 > abs(imp["b"]["rmse_rise"])


def test_tuning_picks_the_best_trial(rows):
    table, model = learners.tune(rows.filter("id < 120"), rows.filter("id >= 120"), ["a", "b"], "y", [{"maxIter": 1, "maxDepth": 0}, SMALL])
    assert table.count() == 2 and model.stages[-1].getNumTrees == SMALL["maxIter"]


def test_recursive_forecast_shape(spark):
    df = spark.createDataFrame([(k, i, float(i % 4)) for k in "ab" for i in range(60)], "k string, i bigint, y double")
    f = learners.lag_gbt(df, ["k"], "i", "y", 4, 9, maxDepth=3, maxIter=10, stepSize=0.5)
    got = {(r["k"], r["idx"]): r["y_pred"] for r in f.collect()}
    assert len(got) == 18 and all(got[k, 60 + s] == pytest.approx(s % 4, abs=0.3) for k in "ab" for s in range(9))
    h = learners.residual_hybrid(df, ["k"], "i", "y", 1, 4.0, 4, 4, maxDepth=2, maxIter=5)
    assert h.count() == 8 and h.filter(F.col("y_pred").isNull()).count() == 0
