"""Forecasts for many series and folds at once, from mergeable training summaries.

A training set is never copied per fold. Rows are summed per (series, segment between cut-offs), the few
segments are accumulated, and each fold reads its own prefix.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType
from pyspark.sql.window import Window as W

from wattframe.joins import on_keys
from wattframe.functions import calendar
from wattframe.operators.panel import CHUNK, over_chunks
from wattframe.operators.quantiles import order_statistics, quantiles
from wattframe.session import cut_lineage

GRID = tuple(i / 10 for i in range(1, 10))  # smoothing parameters searched


def _with_segment(series: DataFrame, cutoffs: DataFrame, keys: Sequence[str], pos: str) -> DataFrame:
    """Segment number = how many cut-offs lie at or before the row; the rows after the last cut-off are a segment that no fold reads."""
    cuts = cutoffs.groupBy(*keys).agg(F.array_sort(F.collect_set("cutoff")).alias("_cuts"))
    # not filtered: a condition on both sides would move into the join, where its lambda finds no columns
    return on_keys(series, cuts, keys).withColumn("_seg", F.size(F.filter("_cuts", lambda c: c <= F.col(pos)))).drop("_cuts")


def training_summaries(series: DataFrame, cutoffs: DataFrame, keys: Sequence[str], pos: str, y: str) -> DataFrame:
    """Per (series, fold): rows, mean, last value and trend line of the rows before the cut-off."""
    x, v = F.col(pos).cast("double"), F.col(y)
    seg = (_with_segment(series, cutoffs, keys, pos).groupBy(*keys, "_seg")
           .agg(F.count("*").alias("_n"), F.sum(x).alias("_sx"), F.sum(v).alias("_sy"), F.sum(x * v).alias("_sxy"),
                F.sum(x * x).alias("_sxx"), F.max(F.struct(F.col(pos).alias("p"), v.alias("y"))).alias("_last")))
    w = W.partitionBy(*keys).orderBy("_seg").rowsBetween(W.unboundedPreceding, 0)
    cum = seg.select(*keys, F.col("_seg").alias("fold"), *[F.sum(c).over(w).alias(c) for c in ("_n", "_sx", "_sy", "_sxy", "_sxx")],
                     F.max("_last").over(w).alias("_last"))
    n, sx, sy = F.col("_n"), F.col("_sx"), F.col("_sy")
    det = n * F.col("_sxx") - sx * sx
    slope = F.coalesce((n * F.col("_sxy") - sx * sy) / F.when(det != 0, det), F.lit(0.0))
    s = cum.select(*keys, "fold", n.alias("n_train"), (sy / n).alias("mean"), F.col("_last.y").alias("last"), slope.alias("slope"),
                   ((sy - slope * sx) / n).alias("intercept"))
    return on_keys(cutoffs.select(*keys, "fold", "cutoff"), s, [*keys, "fold"])


def naive_forecasts(series: DataFrame, cutoffs: DataFrame, targets: DataFrame, keys: Sequence[str], pos: str, y: str,
                    season: int = 24, models: Sequence[str] = ("persistence", "mean", "trend", "seasonal")) -> DataFrame:
    """Long predictions (keys, fold, cutoff, step, idx, model, y_pred) of the closed-form models."""
    s = training_summaries(series, cutoffs, keys, pos, y)
    t = on_keys(targets, s.drop("cutoff"), [*keys, "fold"])
    back = F.col("idx") - season * F.ceil(F.col("step") / season)
    past = series.select(*keys, F.col(pos).alias("_back"), F.col(y).alias("_seasonal"))
    t = on_keys(t.withColumn("_back", back.cast("bigint")), past, [*keys, "_back"], "left")
    value = {"persistence": F.col("last"), "mean": F.col("mean"), "trend": F.col("intercept") + F.col("slope") * F.col("idx"),
             "seasonal": F.col("_seasonal")}
    rows = F.array(*[F.struct(F.lit(m).alias("model"), value[m].alias("y_pred")) for m in models])
    return t.select(*keys, "fold", "cutoff", "step", "idx", F.inline(rows))


def with_actuals(preds: DataFrame, series: DataFrame, keys: Sequence[str], pos: str, y: str) -> DataFrame:
    actual = series.select(*keys, F.col(pos).alias("idx"), F.col(y).alias("y_true"))
    return on_keys(preds, actual, [*keys, "idx"])


# --- Holt smoothing as a scan over chunks ------------------------------------------------------------------

# A stretch of rows turns a start state (l, b) into (l1 l + l2 b + lq, b1 l + b2 b + bq), and adds to the squared error
# rr - 2 (r1 l + r2 b) + v11 l^2 + 2 v12 l b + v22 b^2. Two stretches in a row are one of the same form.
PARTS = ("l1", "l2", "lq", "b1", "b2", "bq", "rr", "r1", "r2", "v11", "v12", "v22")


def _fold_chunks(chunks: list[np.ndarray], marks: list[np.ndarray], alpha: np.ndarray, beta: np.ndarray) -> list[list[list[float]]]:
    """For each chunk rows [mark, alpha, beta, *PARTS] of its first ``mark`` values, for all of its marks and parameter pairs.

    All chunks take a value at once, the longest first, so the loop is as long as the longest chunk.
    """
    order = sorted(range(len(chunks)), key=lambda c: -len(chunks[c]))
    sizes = np.array([len(chunks[c]) for c in order])
    values = np.zeros((max(sizes, default=0), len(order)))
    at: dict[int, list[int]] = {}
    for place, c in enumerate(order):
        values[:len(chunks[c]), place] = chunks[c]
        for mark in marks[c]:
            at.setdefault(int(mark), []).append(place)
    level = np.zeros((3, len(order), len(alpha)))  # coefficients of l, b and 1
    trend = np.zeros_like(level)
    level[0], trend[1] = 1.0, 1.0
    square = np.zeros((6, len(order), len(alpha)))  # of 1*1, 1*l, 1*b, l*l, l*b, b*b
    out: list[list] = [[] for _ in chunks]
    for t in range(len(values) + 1):
        for place in at.get(t, ()):
            own = [np.full(len(alpha), float(t)), alpha, beta, *level[:, place], *trend[:, place], *square[:, place]]
            out[order[place]] += np.stack(own, axis=1).tolist()
        if t == len(values):
            return out
        n = int(np.searchsorted(-sizes, -t, side="left"))  # chunks that go on
        ahead = level[:, :n] + trend[:, :n]
        err = -ahead
        err[2] += values[t, :n, None]
        square[:, :n] += np.stack([err[2] * err[2], -err[2] * err[0], -err[2] * err[1], err[0] * err[0], err[0] * err[1], err[1] * err[1]])
        level[:, :n] = ahead + alpha * err
        trend[:, :n] += alpha * beta * err


def _chunk_maps(alphas: Sequence[float], betas: Sequence[float]):
    a, bt = (g.ravel() for g in np.meshgrid(np.asarray(alphas, float), np.asarray(betas, float), indexing="ij"))

    @F.pandas_udf(ArrayType(ArrayType(DoubleType())))
    def fold(chunks: pd.Series, marks: pd.Series) -> pd.Series:
        return pd.Series(_fold_chunks([np.asarray(ys, float) for ys in chunks], [np.asarray(m, int) for m in marks], a, bt))

    return fold


def _followed(first: Column, then: Column) -> Column:
    """The map of two stretches in a row."""
    a, b = (lambda n: first[n]), (lambda n: then[n])
    out = {f"{k}{i}": b(f"{k}1") * a(f"l{i}") + b(f"{k}2") * a(f"b{i}") for k in "lb" for i in "12"}
    out |= {f"{k}q": b(f"{k}1") * a("lq") + b(f"{k}2") * a("bq") + b(f"{k}q") for k in "lb"}

    def product(i: str, j: str) -> Column:
        return b("v11") * a(f"l{i}") * a(f"l{j}") + b("v12") * (a(f"l{i}") * a(f"b{j}") + a(f"l{j}") * a(f"b{i}")) + b("v22") * a(f"b{i}") * a(f"b{j}")

    out["rr"] = a("rr") + b("rr") - 2 * (b("r1") * a("lq") + b("r2") * a("bq")) + product("q", "q")
    out |= {f"r{i}": a(f"r{i}") + b("r1") * a(f"l{i}") + b("r2") * a(f"b{i}") - product("q", i) for i in "12"}
    out |= {f"v{i}{j}": a(f"v{i}{j}") + product(i, j) for i, j in ("11", "12", "22")}
    return F.struct(*[out[n].alias(n) for n in PARTS])


def holt_states(series: DataFrame, cutoffs: DataFrame, keys: Sequence[str], pos: str, y: str,
                alphas: Sequence[float] = GRID, betas: Sequence[float] = GRID, chunk: int = CHUNK) -> DataFrame:
    """Level, trend and squared error per (series, fold, alpha, beta) after the rows before the cut-off; ``pos`` numbers rows from 0.

    A segmented scan: each chunk of rows is one map of the start state, maps of neighbouring chunks are combined pair by pair in logarithmic rounds
    (each saved), and a fold reads off the few maps whose stretches make up its prefix, and the map of the started chunk.
    No series or fold is ever one list of chunks.
    """
    p, pair = F.col(pos), ["alpha", "beta"]
    ends = cutoffs.groupBy(*keys).agg(F.max("cutoff").alias("_end"))
    rows = on_keys(series.select(*keys, p.alias("_p"), F.col(y).alias("_y")), ends, keys).filter(F.col("_p") < F.col("_end"))
    head = rows.filter("_p <= 1").groupBy(*keys).agg(F.max(F.when(F.col("_p") == 0, F.col("_y"))).alias("_y0"), F.max(F.when(F.col("_p") == 1, F.col("_y"))).alias("_y1"))
    # the first row is in the start state, so the first chunk's values begin at position 1
    started = F.greatest(F.col("cutoff") % chunk - F.when(F.col("cutoff") < chunk, 1).otherwise(0), F.lit(0)).cast("int")
    folds = cutoffs.select(*keys, "fold", "cutoff", F.floor(F.col("cutoff") / chunk).alias("_k"), started.alias("_mark"))
    marks = folds.groupBy(*keys, "_k").agg(F.collect_set("_mark").alias("_marks"))
    blocks = (rows.filter("_p >= 1").groupBy(*keys, F.floor(F.col("_p") / chunk).alias("_k"))
              .agg(F.transform(F.array_sort(F.collect_list(F.struct("_p", "_y"))), lambda r: r["_y"]).alias("_ys")))
    # a chunk's whole map is the one after all of its values
    wanted = F.array_distinct(F.concat(F.coalesce("_marks", F.array().cast("array<int>")), F.array(F.size("_ys"))))
    found = on_keys(blocks, marks, [*keys, "_k"], "left").select(*keys, "_k", F.size("_ys").alias("_n"), F.explode(_chunk_maps(alphas, betas)("_ys", wanted)).alias("_r"))
    maps = cut_lineage(found.select(*keys, "_k", "_n", F.col("_r")[0].cast("int").alias("_mark"), F.col("_r")[1].alias("alpha"), F.col("_r")[2].alias("beta"),
                                    F.struct(*[F.col("_r")[i + 3].alias(n) for i, n in enumerate(PARTS)]).alias("_s")))
    level = maps.filter("_mark = _n").select(*keys, "_k", *pair, "_s")
    nodes, rounds = [], (cutoffs.agg(F.max("cutoff")).first()[0] or 0) // chunk  # one number
    for r in range(int(rounds).bit_length()):
        nodes.append(level.withColumn("_level", F.lit(r)))
        side = [F.max(F.when(F.col("_k") % 2 == odd, F.col("_s"))) for odd in (0, 1)]
        both = level.groupBy(*keys, F.shiftright("_k", 1).alias("_k"), *pair).agg(side[0].alias("_a"), side[1].alias("_b"))
        level = cut_lineage(both.select(*keys, "_k", *pair, F.coalesce(F.when(F.col("_a").isNotNull() & F.col("_b").isNotNull(), _followed(F.col("_a"), F.col("_b"))), "_a", "_b").alias("_s")))
    parts = on_keys(folds, maps.drop("_n"), [*keys, "_k", "_mark"]).select(*keys, "fold", "cutoff", *pair, F.lit(1).alias("_o"), "_s")
    if nodes:
        # the prefix of k chunks is one node for each bit of k, the highest first
        steps = folds.select(*keys, "fold", "cutoff", "_k", F.explode(F.lit(list(range(len(nodes))))).alias("_level"))
        steps = steps.filter(F.expr("shiftright(_k, _level) & 1 = 1")).withColumn("_k", F.expr("shiftleft(shiftright(_k, _level + 1), 1)"))
        tree = nodes[0]
        for n in nodes[1:]:
            tree = tree.unionByName(n)
        parts = parts.unionByName(on_keys(steps, tree, [*keys, "_level", "_k"]).select(*keys, "fold", "cutoff", *pair, (-F.col("_level")).alias("_o"), "_s"))
    per = on_keys(parts.groupBy(*keys, "fold", "cutoff", *pair).agg(F.array_sort(F.collect_list(F.struct("_o", "_s"))).alias("_m")), head, keys)
    start = F.struct(F.col("_y0").alias("l"), (F.col("_y1") - F.col("_y0")).alias("b"), F.lit(0.0).alias("sse"))

    def apply(st, m):
        l, b, s = st["l"], st["b"], m["_s"]
        err = (s["rr"] - 2 * (s["r1"] * l + s["r2"] * b) + s["v11"] * l * l + 2 * s["v12"] * l * b + s["v22"] * b * b)
        return F.struct((s["l1"] * l + s["l2"] * b + s["lq"]).alias("l"), (s["b1"] * l + s["b2"] * b + s["bq"]).alias("b"),
                        (st["sse"] + err).alias("sse"))

    return (per.withColumn("_d", F.aggregate("_m", start, apply))
            .select(*keys, "fold", "cutoff", *pair, F.col("_d.l").alias("level"), F.col("_d.b").alias("trend"), F.col("_d.sse").alias("sse")))


def holt_search(states: DataFrame, keys: Sequence[str]) -> DataFrame:
    """The parameter pair with the least one-step squared error, ties to the smallest pair."""
    best = F.min_by(F.struct("cutoff", "alpha", "beta", "level", "trend", "sse"), F.struct(F.round("sse", 6), "alpha", "beta"))
    return states.groupBy(*keys, "fold").agg(best.alias("_b")).select(*keys, "fold", "_b.*")


def holt_forecast(states: DataFrame, keys: Sequence[str], horizon: int, model: str = "holt") -> DataFrame:
    steps = states.select(*keys, "fold", "cutoff", "level", "trend", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("step"))
    return steps.select(*keys, "fold", "cutoff", "step", (F.col("cutoff") + F.col("step") - 1).cast("bigint").alias("idx"),
                        F.lit(model).alias("model"), (F.col("level") + F.col("step") * F.col("trend")).alias("y_pred"))


def single_cutoff(series: DataFrame, keys: Sequence[str], cutoff: Column) -> DataFrame:
    """One fold per series."""
    return series.groupBy(*keys).agg(cutoff.cast("bigint").alias("cutoff")).select(*keys, F.lit(0).alias("fold"), "cutoff")


def walk_forward(series: DataFrame, cutoffs: DataFrame, targets: DataFrame, keys: Sequence[str], pos: str, y: str, horizon: int,
                 season: int = 24, holt: bool = False) -> DataFrame:
    """Every fold and model in one plan, with actuals."""
    preds = naive_forecasts(series, cutoffs, targets, keys, pos, y, season)
    if holt:
        h = holt_forecast(holt_search(holt_states(series, cutoffs, keys, pos, y), keys), keys, horizon)
        preds = preds.unionByName(h)
    return with_actuals(preds, series, keys, pos, y)


# --- autoregression with harmonics -------------------------------------------------------------------------

@F.pandas_udf(ArrayType(DoubleType()))
def _solve_normal(xtx: pd.Series, xty: pd.Series) -> pd.Series:
    out = []
    for a, b in zip(xtx, xty):
        b = np.asarray(b, dtype=float)
        d = len(b)
        m = np.zeros((d, d))
        m[np.triu_indices(d)] = np.asarray(a, dtype=float)
        m = m + m.T - np.diag(np.diag(m))
        # columns are scaled to unit length before the least-squares solve
        s = np.sqrt(np.where(np.diag(m) > 0, np.diag(m), 1.0))
        out.append((np.linalg.lstsq(m / np.outer(s, s), b / s, rcond=None)[0] / s).tolist())
    return pd.Series(out)


def fit_ar_fourier(train: DataFrame, keys: Sequence[str], pos: str, y: str, p: int, k: int, period: float) -> DataFrame:
    """Least squares on p lags and k harmonics per series: coefficients [1, lags, sin and cos pairs] and the last p values.

    The normal equations are sums, so any number of series of any length is fitted by one aggregate.
    """
    lagged = over_chunks(train, keys, pos, lambda w: [F.lag(y, i).over(w).alias(f"_l{i}") for i in range(1, p + 1)], back=p) if p else train
    if p:
        lagged = lagged.filter(F.col(f"_l{p}").isNotNull())
    lagged = lagged.withColumns({f"_h{i}": c for i, c in enumerate(calendar.fourier(F.col(pos), period, k))})
    xs = [F.lit(1.0), *[F.col(f"_l{i}") for i in range(1, p + 1)], *[F.col(f"_h{i}") for i in range(2 * k)]]
    d = len(xs)
    sums = lagged.groupBy(*keys).agg(
        F.array(*[F.sum(xs[i] * xs[j]) for i in range(d) for j in range(i, d)]).alias("_xtx"),
        F.array(*[F.sum(x * F.col(y)) for x in xs]).alias("_xty"))
    coef = sums.select(*keys, _solve_normal("_xtx", "_xty").alias("coef"))
    n = train.groupBy(*keys).agg((F.max(pos) + 1).alias("cutoff"))
    tail = (on_keys(train, n, keys).filter(F.col(pos) >= F.col("cutoff") - max(p, 1)).groupBy(*keys, "cutoff")
            .agg(F.transform(F.sort_array(F.collect_list(F.struct(F.col(pos).alias("p"), F.col(y).alias("y"))), asc=False),
                             lambda r: r["y"]).alias("tail")))
    return on_keys(coef, tail, keys)


def _harmonics(coef: Column, idx: Column, p: int, k: int, period: float) -> Column:
    total = F.element_at(coef, 1)
    for i, c in enumerate(calendar.fourier(idx, period, k)):
        total = total + F.element_at(coef, p + 2 + i) * c
    return total


def ar_fourier_forecast(fit: DataFrame, keys: Sequence[str], horizon: int, p: int, k: int, period: float, model: str = "ar_fourier") -> DataFrame:
    """Recursive forecast: each step feeds the next as its newest lag."""
    def step(state, i):
        idx = (F.col("cutoff") + i - 1).cast("double")
        ar = F.aggregate(F.zip_with(state["lags"], F.slice("coef", 2, max(p, 1)), lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b)
        nxt = _harmonics(F.col("coef"), idx, p, k, period) + (ar if p else F.lit(0.0))
        return F.struct(F.slice(F.concat(F.array(nxt), state["lags"]), 1, max(p, 1)).alias("lags"), F.concat(state["out"], F.array(nxt)).alias("out"))

    start = F.struct(F.col("tail").alias("lags"), F.lit([]).cast("array<double>").alias("out"))
    run = F.aggregate(F.sequence(F.lit(1), F.lit(horizon)), start, step)
    return (fit.withColumn("_o", run["out"]).select(*keys, "cutoff", F.posexplode("_o").alias("_i", "y_pred"))
            .select(*keys, F.lit(0).alias("fold"), "cutoff", (F.col("_i") + 1).alias("step"),
                    (F.col("cutoff") + F.col("_i")).cast("bigint").alias("idx"), F.lit(model).alias("model"), "y_pred"))


def harmonic_fitted(df: DataFrame, fit: DataFrame, keys: Sequence[str], pos: str, k: int, period: float, name: str) -> DataFrame:
    """In-sample value of a fit without lags."""
    return on_keys(df, fit.select(*keys, "coef"), keys).withColumn(name, _harmonics(F.col("coef"), F.col(pos).cast("double"), 0, k, period)).drop("coef")


# --- bands -------------------------------------------------------------------------------------------------

def conformal_band(val: DataFrame, test: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred", level: float = 0.9,
                   finite_sample: bool = False) -> DataFrame:
    """Band of the test rows from the quantile of absolute validation errors, per ``by`` group."""
    e = val.select(*by, F.abs(F.col(y) - F.col(p)).alias("_e"))
    if finite_sample:
        q = order_statistics(e, by, "_e", {"_q": lambda n: F.least(F.ceil((n + 1) * F.lit(level)), n) - 1})
    else:
        q = quantiles(e, by, "_e", {"_q": level})
    j = on_keys(test, q.select(*by, "_q"), by, "left") if by else test.withColumn("_q", q.select("_q").scalar())
    return j.withColumn("lo", F.col(p) - F.col("_q")).withColumn("hi", F.col(p) + F.col("_q")).drop("_q")


def gaussian_band(val: DataFrame, test: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred", z: float = 1.645) -> DataFrame:
    """Band of z residual deviations, calibrated on validation rows only."""
    s = val.groupBy(*by).agg(F.stddev_pop(F.col(y) - F.col(p)).alias("_s"))
    j = on_keys(test, s, by, "left") if by else test.withColumn("_s", s.scalar())
    return j.withColumn("lo", F.col(p) - z * F.col("_s")).withColumn("hi", F.col(p) + z * F.col("_s")).drop("_s")


def comparison_table(parts: dict[str, DataFrame], order: Sequence[str]) -> DataFrame:
    """Metric tables of several targets in one, tagged and ordered."""
    out = None
    for target, df in parts.items():
        d = df.withColumn("target", F.lit(target))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out.orderBy(*order)
