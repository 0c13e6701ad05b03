"""Boosted-tree forecasts with MLlib: direct, pooled, residual-transfer, zero-shot, recursive, and their tuning."""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor
from functools import partial, reduce
from typing import TypeVar

import numpy as np
import pandas as pd
from pyspark import StorageLevel, inheritable_thread_target
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import GBTRegressionModel, GBTRegressor
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.joins import on_keys
from wattframe.operators import metrics
from wattframe.operators.panel import over_chunks, with_row_index
from wattframe.session import checkpoint_folder, cut_lineage

T = TypeVar("T")
DEFAULTS = {"maxDepth": 4, "maxIter": 20, "stepSize": 0.1, "seed": 42}


def fit_gbt(train: DataFrame, features: Sequence[str], target: str, weight: str | None = None, **params) -> PipelineModel:
    """One boosted-tree pipeline over the whole training table; rows without a target or weight are left out.

    A missing feature is filled with its median over the training rows, in the fit and in later predictions, so every model scores
    the same rows.
    """
    checkpoint_folder(train.sparkSession)
    gbt = GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="y_pred", **{**DEFAULTS, **params})
    if weight:
        gbt = gbt.setWeightCol(weight)
    filled = [f"_filled_{i}" for i in range(len(features))]
    imputer = Imputer(strategy="median", inputCols=list(features), outputCols=filled)
    assembler = VectorAssembler(inputCols=filled, outputCol="_x", handleInvalid="error")
    needed = [target, *([weight] if weight else [])]
    # boosting passes over its input several times; the cache spills to disk and is rebuilt if an executor is lost
    rows = train.select(*_doubles(features), *needed).na.drop(subset=needed).persist(StorageLevel.MEMORY_AND_DISK)
    try:
        return Pipeline(stages=[imputer, assembler, gbt]).fit(rows)
    finally:
        rows.unpersist()


def _doubles(features: Sequence[str]) -> list[Column]:
    return [F.col(f).cast("double").alias(f) for f in features]


def predict(model: PipelineModel, df: DataFrame, features: Sequence[str]) -> DataFrame:
    """All rows of ``df`` with y_pred."""
    kept = [F.col(c).cast("double").alias(c) if c in features else F.col(c) for c in df.columns]
    return model.transform(df.select(*kept)).select(*df.columns, "y_pred")


def direct(train: DataFrame, test: DataFrame, features: Sequence[str], target: str, **params) -> DataFrame:
    """One model for one horizon, trained on the target regions only."""
    return predict(fit_gbt(train, features, target, **params), test, features)


def pooled_transfer(source: DataFrame, train: DataFrame, test: DataFrame, features: Sequence[str], target: str,
                    target_weight: float = 1.0, **params) -> DataFrame:
    """Source and target rows in one training set, the target rows with a weight of their own if asked for."""
    cols = [*features, target]
    both = source.select(*cols, F.lit(1.0).alias("_wt")).unionByName(train.select(*cols, F.lit(target_weight).alias("_wt")))
    return predict(fit_gbt(both, features, target, "_wt", **params), test, features)


def residual_transfer(source: DataFrame, train: DataFrame, test: DataFrame, features: Sequence[str], target: str, **params) -> DataFrame:
    """A base model on source rows, and a second one on what it leaves unexplained on the target rows."""
    base = fit_gbt(source, features, target, **params)
    left = predict(base, train, features).withColumn("_res", F.col(target) - F.col("y_pred")).drop("y_pred")
    second = fit_gbt(left, features, "_res", **params)
    first = predict(base, test, features).withColumnRenamed("y_pred", "_base")
    return predict(second, first, features).withColumn("y_pred", F.col("_base") + F.col("y_pred")).drop("_base")


def zero_shot(source: DataFrame, test: DataFrame, features: Sequence[str], target: str, **params) -> DataFrame:
    """Fit on source regions only, score the target."""
    return predict(fit_gbt(source, features, target, **params), test, features)


def lag_gbt(train: DataFrame, keys: Sequence[str], pos: str, y: str, p: int, horizon: int, model: str = "lag_gbt", **params) -> DataFrame:
    """Trees on p lags, pooled over the series; each forecast step feeds the next.

    The recursion carries one row per series: the fitted trees are read once, and all steps of many series run in one pass. A series with fewer
    than p rows has its forecast rows too, with a NULL y_pred.
    """
    names = [f"lag_{i}" for i in range(1, p + 1)]
    lagged = over_chunks(train, keys, pos, lambda w: [F.lag(y, i).over(w).alias(n) for i, n in enumerate(names, 1)], back=p)
    trees = _tree_arrays(fit_gbt(lagged.na.drop(subset=names), names, y, **params).stages[-1])
    end = train.groupBy(*keys).agg((F.max(pos) + 1).alias("cutoff"))
    tail = on_keys(train, end, keys) if keys else train.withColumn("cutoff", end.scalar())
    state = (tail.filter(F.col(pos) >= F.col("cutoff") - p).groupBy(*keys, "cutoff")
             .agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(y).alias("y"))), asc=False),
                              lambda r: r["y"]).alias("_lags"))
             .withColumn("_lags", F.concat("_lags", F.array_repeat(F.lit(None).cast("double"), p - F.size("_lags")))))

    @F.pandas_udf("array<double>")
    def ahead(lags: pd.Series) -> pd.Series:
        x = np.array(lags.tolist(), float).reshape(-1, p)  # NULL becomes NaN
        short = np.isnan(x).any(axis=1)
        out = np.empty((len(x), horizon))
        for i in range(horizon):
            out[:, i] = _tree_sums(trees, x)
            x = np.concatenate([out[:, i:i + 1], x[:, :-1]], axis=1)
        return pd.Series([None if none else row for row, none in zip(out, short, strict=True)])

    found = F.coalesce(ahead("_lags"), F.array_repeat(F.lit(None).cast("double"), horizon))
    return (state.select(*keys, "cutoff", F.posexplode(found).alias("_i", "y_pred"))
            .select(*keys, F.lit(0).alias("fold"), "cutoff", (F.col("_i") + 1).alias("step"),
                    (F.col("cutoff") + F.col("_i")).cast("bigint").alias("idx"), F.lit(model).alias("model"), "y_pred"))


def _tree_arrays(model) -> list[tuple]:
    """(weight, feature, threshold, left, right, value) arrays of each tree of a fitted ensemble; a leaf has feature -1."""
    out = []
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        rows = []

        def add(node, rows=rows) -> int:
            at = len(rows)
            rows.append([-1, 0.0, 0, 0, node.prediction()])
            if node.subtreeDepth() > 0:
                split = node.split()
                rows[at][:2] = [split.featureIndex(), split.threshold()]
                rows[at][2] = add(node.leftChild())
                rows[at][3] = add(node.rightChild())
            return at

        add(tree._call_java("rootNode"))
        feature, threshold, left, right, value = (np.array(c) for c in zip(*rows, strict=True))
        out.append((weight, feature.astype(int), threshold.astype(float), left.astype(int), right.astype(int), value.astype(float)))
    return out


def _tree_sums(trees: list[tuple], x: np.ndarray) -> np.ndarray:
    """The ensemble's predictions for the rows of ``x``."""
    total = np.zeros(len(x))
    rows = np.arange(len(x))
    for weight, feature, threshold, left, right, value in trees:
        at = np.zeros(len(x), int)
        while (inner := feature[at] >= 0).any():
            go_left = x[rows, np.maximum(feature[at], 0)] <= threshold[at]
            at = np.where(inner, np.where(go_left, left[at], right[at]), at)
        total += weight * value[at]
    return total


def bin_features(rows: DataFrame, features: Sequence[str], learn: Column | None = None, bins: int = 32) -> DataFrame:
    """``rows`` with ``_x``, the features as one vector of bin numbers, saved: made once for all fits on any part of the rows.

    Bins are cut at quantiles of the rows where ``learn`` holds; a missing feature takes the bin of their median, and bin 0 where they have none.
    One aggregate finds all cuts; the driver gets ``bins`` numbers a feature.
    """
    known = rows if learn is None else rows.filter(learn)
    steps = [k / bins for k in range(1, bins)]
    values = [F.col(f).cast("double") for f in features]
    found = known.agg(*[F.percentile_approx(F.when(~F.isnan(v), v), [*steps, 0.5]).alias(f"q{i}") for i, v in enumerate(values)]).first()
    cuts = [sorted(set(q[:-1])) if q else [] for q in found]
    filled = [F.coalesce(F.when(~F.isnan(v), v), F.lit(q[-1] if q else 0.0)) for v, q in zip(values, found, strict=True)]
    numbers = [sum((F.when(v > c, 1.0).otherwise(0.0) for c in own), F.lit(0.0)).alias(f"_b{i}") for i, (v, own) in enumerate(zip(filled, cuts, strict=True))]
    names = [f"_b{i}" for i in range(len(features))]
    whole = rows.select("*", *numbers)
    return cut_lineage(VectorAssembler(inputCols=names, outputCol="_x").transform(whole).drop(*names))


def fit_binned(train: DataFrame, target: str, weight: str | None = None, **params) -> GBTRegressionModel:
    """Boosted trees on the rows of ``bin_features`` that have a target (and weight)."""
    needed = [target, *([weight] if weight else [])]
    gbt = GBTRegressor(featuresCol="_x", labelCol=target, predictionCol="y_pred", **{**DEFAULTS, **params})
    return (gbt.setWeightCol(weight) if weight else gbt).fit(train.select("_x", *needed).na.drop(subset=needed))


def predict_binned(model: GBTRegressionModel, df: DataFrame) -> DataFrame:
    """All rows of ``df`` with y_pred."""
    return model.transform(df).select(*df.columns, "y_pred")


def residual_binned(base: GBTRegressionModel, train: DataFrame, target: str, **params) -> Callable[[DataFrame], DataFrame]:
    """``residual_transfer`` on binned rows over a base model that is fitted already: a function that adds y_pred to rows."""
    left = predict_binned(base, train).withColumn("_res", F.col(target) - F.col("y_pred")).drop("y_pred")
    second = fit_binned(left, "_res", **params)

    def forecast(rows: DataFrame) -> DataFrame:
        first = predict_binned(base, rows).withColumnRenamed("y_pred", "_base")
        return predict_binned(second, first).withColumn("y_pred", F.col("_base") + F.col("y_pred")).drop("_base")

    return forecast


def together(jobs: Sequence[Callable[[], T]], at_once: int = 8) -> list[T]:
    """What each of ``jobs`` returns, in order. They submit their Spark jobs from ``at_once`` threads, so small fits fill a cluster side by side."""
    with ThreadPoolExecutor(max(1, at_once)) as pool:
        return [f.result() for f in [pool.submit(inheritable_thread_target(job)) for job in jobs]]


def rolling_origin(panel: DataFrame, folds: DataFrame, keys: Sequence[str], k: int, row: str, features: Sequence[str], target: str,
                   by: Sequence[str] = (), at_once: int = 8, **params) -> DataFrame:
    """Refit per fold 1 to ``k`` (train before, test inside) and score each; ``folds`` holds each series' (fold, test_from, test_to).

    Features are binned and saved once, with a row for each fold that reads it; the folds' fits run side by side. Bins are cut at quantiles of
    the rows before the first test, so no fold sees ahead.
    """
    placed = on_keys(panel, folds.filter("fold is not null").select(*keys, "fold", "test_from", "test_to"), keys)
    placed = placed.filter((F.col(row) < F.col("test_to")) & F.col(target).isNotNull())
    binned = bin_features(placed, features, (F.col("fold") == 1) & (F.col(row) < F.col("test_from")))

    def fold_scores(fold: int) -> DataFrame:
        own = binned.filter(F.col("fold") == fold)
        model = fit_binned(own.filter(F.col(row) < F.col("test_from")), target, **params)
        return predict_binned(model, own.filter(F.col(row) >= F.col("test_from"))).select("fold", *by, F.col(target).alias("y_true"), "y_pred")

    parts = together([partial(fold_scores, fold) for fold in range(1, k + 1)], at_once)
    return metrics.score(reduce(DataFrame.unionByName, parts), ["fold", *by])


def tune(train: DataFrame, val: DataFrame, features: Sequence[str], target: str, grid: Sequence[Mapping], at_once: int = 8,
         rungs: int = 1) -> tuple[DataFrame, PipelineModel]:
    """Scores of the parameter maps on the validation rows, and the best one refitted on train and validation together, for rows that aren't binned.

    Rows are binned and saved once for all trials, by quantiles of the training rows, and the trials of a rung run side by side. With ``rungs`` above 1 the trials are
    halved: every rung but the last fits with half the rounds of the next, and its better half goes on. A trial's row holds its last rung
    and the rounds it had there. Ties go to the earlier trial.
    """
    rows = bin_features(train.withColumn("_fit", F.lit(True)).unionByName(val.withColumn("_fit", F.lit(False))), features, F.col("_fit"))
    left, found = list(range(len(grid))), {}

    def trial(number: int, rung: int) -> tuple[float, int]:
        params = {**DEFAULTS, **grid[number]}
        params["maxIter"] = max(1, params["maxIter"] >> (rungs - 1 - rung))
        model = fit_binned(rows.filter("_fit"), target, **params)
        error = predict_binned(model, rows.filter(~F.col("_fit"))).agg(metrics.rmse(target, "y_pred").alias("rmse")).first().rmse  # one number a trial
        return error, params["maxIter"]

    for rung in range(rungs):
        for number, (error, rounds) in zip(left, together([partial(trial, n, rung) for n in left], at_once), strict=True):
            found[number] = (rung + 1, rounds, error)
        order = sorted(left, key=lambda n: (math.inf if found[n][2] is None else found[n][2], n))
        left = sorted(order[:-(-len(order) // 2)]) if rung < rungs - 1 else order
    table = train.sparkSession.createDataFrame([(n, str(dict(sorted(grid[n].items()))), *found[n]) for n in range(len(grid))],
                                               "trial int, params string, rung int, rounds int, rmse double")
    return table, fit_gbt(train.unionByName(val), features, target, **grid[left[0]])


def feature_importance(model: PipelineModel, df: DataFrame, features: Sequence[str], target: str, keys: Sequence[str], seed: int = 42) -> DataFrame:
    """Impurity importance, and the rise in RMSE when one feature is taken from a seeded random other row.

    Rows with a missing feature count, as the model fills it; those without a target don't. The random pairing is a join of two row numberings, by key order and by hash order, made without a global sort.
    """
    d = df.na.drop(subset=[target]).select(*keys, target, F.struct(*features).alias("_own"))
    text = F.concat_ws("|", *[F.col(k).cast("string") for k in keys])
    mixed = d.withColumn("_h", F.md5(F.concat(text, F.lit(f"|{seed}")))).withColumn("_g", F.md5(text))
    by_key = with_row_index(mixed, [], ["_g"], F.substring("_g", 1, 3), index="_i").drop("_h", "_g")
    by_hash = with_row_index(mixed, [], ["_h"], F.substring("_h", 1, 3), index="_i").select("_i", F.col("_own").alias("_other"))
    j = by_key.join(by_hash, "_i")
    versions = F.array(F.struct(F.lit("").alias("feature"), F.col("_own").alias("_f")), *[
        F.struct(F.lit(f).alias("feature"),
                 F.struct(*[(F.col(f"_other.{c}") if c == f else F.col(f"_own.{c}")).alias(c) for c in features]).alias("_f"))
        for f in features])
    long = j.select(target, F.inline(versions)).select(target, "feature", "_f.*")
    score = model.transform(long).groupBy("feature").agg(metrics.rmse(target, "y_pred").alias("rmse"))
    base = score.filter("feature = ''").select("rmse")
    impurity = model.stages[-1].featureImportances.toArray().tolist()
    table = F.map_from_arrays(F.lit(list(features)), F.lit(impurity))
    return (score.filter("feature <> ''").select("feature", F.element_at(table, F.col("feature")).alias("impurity"),
                                                 (F.col("rmse") - base.scalar()).alias("rmse_rise")))


def _tree_paths(model: GBTRegressionModel) -> list[list[tuple[float, list[tuple[int, float, float, float]]]]]:
    """For each tree its leaves: weighted value, and for each feature on the way (feature, above, up to, share): the leaf's range of the feature
    and the share of the training rows at its nodes that its splits let through."""
    out = []
    for weight, tree in zip(model.treeWeights, model.trees, strict=True):
        leaves = []

        def walk(node, way, weight=weight, leaves=leaves) -> None:
            if node.subtreeDepth() == 0:
                leaves.append((weight * node.prediction(), [(f, *r) for f, r in way.items()]))
                return
            split, rows = node.split(), node.impurityStats().count()
            f, at = split.featureIndex(), split.threshold()
            for child, left in ((node.leftChild(), True), (node.rightChild(), False)):
                lo, hi, share = way.get(f, (-math.inf, math.inf, 1.0))
                walk(child, {**way, f: (lo, min(hi, at), share * child.impurityStats().count() / rows) if left else
                             (max(lo, at), hi, share * child.impurityStats().count() / rows)})

        walk(tree._call_java("rootNode"), {})
        out.append(leaves)
    return out


def _contributions(trees, x: np.ndarray) -> np.ndarray:
    """Shapley values of each row's features (columns) and the mean (last column), over all subsets of the features on a leaf's way."""
    out = np.zeros((len(x), x.shape[1] + 1))
    for leaves in trees:
        for value, way in leaves:
            holds = [(x[:, f] > lo) & (x[:, f] <= hi) for f, lo, hi, _ in way]
            factors = [(h.astype(float), share) for h, (*_, share) in zip(holds, way, strict=True)]
            out[:, -1] += value * math.prod(share for _, share in factors)
            for i, (f, *_) in enumerate(way):
                rest = factors[:i] + factors[i + 1:]
                # the sum over subsets by their size: a known feature counts if it holds, an unknown one with its share
                by_size = [np.ones(len(x))]
                for h, share in rest:
                    grown = [share * c for c in by_size] + [np.zeros(len(x))]
                    for k, c in enumerate(by_size):
                        grown[k + 1] = grown[k + 1] + h * c
                    by_size = grown
                n = len(way)
                weighed = sum(math.factorial(k) * math.factorial(n - 1 - k) / math.factorial(n) * c for k, c in enumerate(by_size))
                out[:, f] += value * (factors[i][0] - factors[i][1]) * weighed
    return out


def contributions(model: PipelineModel, df: DataFrame, features: Sequence[str], keys: Sequence[str]) -> DataFrame:
    """keys, y_pred, mean, and one column ``by_<feature>`` each: what a feature adds to the model's mean in each row.

    Exact Shapley values of the trees, where a feature that isn't known follows the training rows down both sides of its splits. Mean and
    contributions add up to y_pred. The fitted trees are read once; rows are taken a batch at a time.
    """
    trees = _tree_paths(model.stages[-1])

    @F.pandas_udf("array<double>")
    def explain(x: pd.Series) -> pd.Series:
        return pd.Series(list(_contributions(trees, np.array(x.tolist(), float).reshape(len(x), -1))))

    kept = [F.col(c).cast("double").alias(c) if c in features else F.col(c) for c in df.columns]
    found = model.transform(df.select(*kept)).withColumn("_c", explain(vector_to_array("_x")))
    return found.select(*keys, "y_pred", F.col("_c")[len(features)].alias("mean"), *[F.col("_c")[i].alias(f"by_{f}") for i, f in enumerate(features)])


def residual_hybrid(train: DataFrame, keys: Sequence[str], pos: str, y: str, k: int, period: float, p: int, horizon: int, **params) -> DataFrame:
    """Harmonic base plus a lag model on its in-sample residuals."""
    from wattframe.operators import forecast as fc

    base = fc.fit_ar_fourier(train, keys, pos, y, 0, k, period)
    resid = (fc.harmonic_fitted(train, base, keys, pos, k, period, "_fit").withColumn("_res", F.col(y) - F.col("_fit")))
    a = fc.ar_fourier_forecast(base, keys, horizon, 0, k, period, "hybrid")
    b = lag_gbt(resid, keys, pos, "_res", p, horizon, **params).select(*keys, "idx", F.col("y_pred").alias("_r"))
    return on_keys(a, b, [*keys, "idx"]).withColumn("y_pred", F.col("y_pred") + F.col("_r")).drop("_r").select(*a.columns)
