"""Forecast tables and the demand-forecast studies."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import partial

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.joins import on_keys
from wattframe.functions import calendar, clean
from wattframe.operators import disagg, forecast as fc, learners, metrics, panel, reshape, splits
from wattframe.operators.relational import combine_first
from wattframe.session import cut_lineage
from wattframe.sources.tables import replace_slice


def build_forecast_tables(load_wide: DataFrame, ts: str, monthly: DataFrame, sources: tuple[str, str], region: str,
                          capacity: DataFrame, macro: Sequence[DataFrame], year: str = "yr", month: str = "mo", fresh_weather: DataFrame | None = None,
                          holidays: DataFrame | None = None) -> dict[str, DataFrame]:
    """Load, weather, calendar and macro tables from a wide load file, two monthly demand sources and capacity factors.

    ``capacity`` holds ts, region_id, wind_cf, solar_cf; of the ``macro`` tables (year, region_id, ..) the later ones win. Measured values of ``fresh_weather``
    (ts and any of the weather columns, one row a time) win over the proxies. ``holidays`` has a date column d.
    """
    cols = [c for c in load_wide.columns if c != ts]
    measured = (reshape.melt(load_wide, [ts], cols, "series", "load_mw").filter(F.col("load_mw").isNotNull())
                .select(F.col(ts).alias("ts"), clean.header_region("series").alias("region_id"), "load_mw",
                        F.lit("measured").alias("source"), F.lit(0).alias("is_synthetic")))
    profile = disagg.intraday_profile(measured, "ts", "load_mw")
    demand = disagg.fallback_source(monthly, *sources, "demand", ("official", "scaled"))
    spread = disagg.disaggregate(demand, profile, "demand", keys=("source",), year=year, month=month)
    synthetic = spread.select("ts", F.lit(region).alias("region_id"), "load_mw",
                              F.concat(F.lit("monthly_disaggregated_"), "source").alias("source"), F.lit(1).alias("is_synthetic"))
    load = splits.union_all(measured, synthetic)
    ranked = splits.union_all(*[m.withColumn("_rank", F.lit(i)) for i, m in enumerate(macro)])
    weather = disagg.proxy_variables(capacity, "wind_cf", "solar_cf")
    if fresh_weather is not None:
        weather = combine_first(weather, fresh_weather, ["ts"], [c for c in fresh_weather.columns if c != "ts"])
    return {"load": load, "weather": weather, "calendar": calendar.calendar_table(load, "ts", holidays),
            "macro": splits.keep_last(ranked, ["year", "region_id"], ["_rank"]).drop("_rank")}


def with_exogenous(load: DataFrame, keys: Sequence[str], ts: str, hourly: DataFrame | None = None, weather: DataFrame | None = None,
                   macro: DataFrame | None = None, year: str = "year") -> DataFrame:
    """``load`` with the columns of tables by time (``hourly``: ts), by time and series (``weather``: ts, keys) and by year and series (``macro``: year, keys).

    All joins are left joins where NULL keys meet, so no load row is lost; each table has one row a key.
    """
    out = load
    if hourly is not None:
        out = on_keys(out, hourly, [ts], "left")
    if weather is not None:
        out = on_keys(out, weather, [ts, *keys], "left")
    if macro is not None:
        out = on_keys(out.withColumn(year, F.year(ts)), macro, [year, *keys], "left").drop(year)
    return out


FEATURES = (*[f"lag_{k}" for k in panel.FEATURE_LAGS], *[f"roll_{n}" for n in panel.FEATURE_ROLLS], "hour", "dow", "month", "is_weekend")


def horizon_table(load: DataFrame, keys: Sequence[str], ts: str, value: str, horizons: Sequence[int], train: float = 0.6, val: float = 0.2,
                  dense: bool = False, season: int = 24) -> DataFrame:
    """Lags, rolls, calendar and split label of an hourly panel, once for all horizons: ``ahead`` holds each one's target and seasonal naive.

    ``dense`` says that the panel has no gaps, which saves numbering its rows. Rows without a full history are left out.
    """
    d = panel.with_hour_position(load, ts)
    s = splits.positional_split(d, keys, "pos", train, val) if dense else splits.chronological_split(d, keys, ts, F.col(ts).cast("date"), train, val)
    f = calendar.with_parts(panel.horizon_panel(s, keys, "pos", value, horizons, season=season, dense=dense), ts, ["hour", "dow", "month", "is_weekend"])
    return f.filter(F.col(f"lag_{max(panel.FEATURE_LAGS)}").isNotNull())


def feature_table(load: DataFrame, keys: Sequence[str], ts: str, value: str, horizon: int, train: float = 0.6, val: float = 0.2, dense: bool = False) -> DataFrame:
    """Lags, rolls, calendar, target and split label of a panel at one horizon, saved."""
    return cut_lineage(panel.at_horizon(horizon_table(load, keys, ts, value, [horizon], train, val, dense), [horizon], horizon))


def _long(df: DataFrame, keys: Sequence[str], model: str, horizon: int, pred: Column) -> DataFrame:
    return df.select(*keys, "ts", "pos", "split", F.lit(horizon).alias("horizon"), F.lit(model).alias("model"), F.col("target").alias("y_true"), pred.alias("y_pred"))


def _evaluate(preds: DataFrame, models: Sequence[str], train: DataFrame, keys: Sequence[str], value: str, horizons: Sequence[int], season: int, per_region: bool,
              tail: str = "normal") -> dict[str, DataFrame]:
    by = ["horizon", "model", *(keys if per_region else [])]
    test = fc.conformal_band(preds.filter("split = 'val'"), preds.filter("split = 'test'"), by)
    scale = metrics.mase_scale(train, ["horizon", *keys], "pos", value, season)
    table = metrics.with_mase(metrics.score(test, ["horizon", "model", *keys], lo="lo", hi="hi"), scale, ["horizon", *keys], season=True)
    errors = metrics.paired_errors(test, ["horizon", *keys, "pos"], "model", "y_true", "y_pred", metrics.all_pairs(models))
    # the number of autocovariances differs by horizon
    tests = [metrics.diebold_mariano(errors.filter(F.col("horizon") == h), ["horizon", "model_a", "model_b"], keys, "pos", h, "flat") for h in horizons]
    return {"predictions": test, "metrics": table, "comparison": metrics.with_p_value(splits.union_all(*tests), tail)}


def _study(table: DataFrame, keys: Sequence[str], target: Column, horizons: Sequence[int], features: Sequence[str], value: str, train: float, val: float,
           fits: Callable | None, at_once: int) -> tuple[DataFrame, DataFrame]:
    """Predictions of all models and horizons for the target's rows after the training ones, and its training rows by horizon.

    The table is binned and saved once; ``fits`` makes one horizon's predictions from source, training and other rows, and the horizons run side by side.
    A horizon's rows are split by their place among those that have a full history and a target. Without ``fits`` there are just the naive ones.
    """
    first = max(panel.FEATURE_LAGS)

    def share(horizon: int, part: float) -> Column:
        return F.floor((F.col("n_rows") - first - horizon) * F.lit(float(part))) + first

    # bins are cut where every horizon learns
    learned = F.when(target, F.col("idx") < share(max(horizons), train)).otherwise(F.col("idx") < share(max(horizons), train + val))
    rows = cut_lineage(table) if fits is None else learners.bin_features(table, features, learned).drop(*features)

    def one(horizon: int) -> tuple[DataFrame, DataFrame]:
        split = F.when(F.col("idx") < share(horizon, train), "train").when(F.col("idx") < share(horizon, train + val), "val").otherwise("test")
        at = panel.at_horizon(rows, horizons, horizon).withColumn("split", split)
        own, source = at.filter(target), at.filter(~target & F.col("split").isin("train", "val"))
        fit, rest = own.filter("split = 'train'"), own.filter("split <> 'train'")
        preds = fits(source, fit, rest) if fits else {}
        naive = _long(rest, keys, "seasonal_naive", horizon, F.col("snaive"))
        return splits.union_all(naive, *[_long(p, keys, name, horizon, F.col("y_pred")) for name, p in preds.items()]), fit.select(*keys, "pos", value, F.lit(horizon).alias("horizon"))

    preds, trained = zip(*learners.together([partial(one, h) for h in horizons], at_once), strict=True)
    return cut_lineage(splits.union_all(*preds)), splits.union_all(*trained)


def train_and_evaluate(load: DataFrame, keys: Sequence[str], ts: str, value: str, target: Column, horizons: Sequence[int] = (1, 6, 24, 168),
                       season: int = 24, exogenous: Sequence[str] = (), dense: bool = False, at_once: int = 4, learned: bool = True, **params) -> dict[str, DataFrame]:
    """Seasonal naive, own model, pooled transfer and residual transfer of the target region at all horizons.

    One feature table serves all of them: targets and seasonal naive forecasts lie in an array over the horizons. ``exogenous`` names numeric columns of
    ``load`` that are features too (see ``with_exogenous``). At a horizon all models are scored on the same rows.
    Without ``learned`` only the naive rows are made.
    """
    def fits(source, train, rest):
        jobs = [lambda: learners.fit_binned(train, "target", **params), lambda: learners.fit_binned(source.select("_x", "target").unionByName(train.select("_x", "target")), "target", **params),
                lambda: learners.fit_binned(source, "target", **params)]
        own, pooled, base = learners.together(jobs)
        return {"own": learners.predict_binned(own, rest), "pooled": learners.predict_binned(pooled, rest),
                "transfer": learners.residual_binned(base, train, "target", **params)(rest)}

    table = horizon_table(load, keys, ts, value, horizons, dense=dense, season=season)
    preds, train = _study(table, keys, target, horizons, [*FEATURES, *exogenous], value, 0.6, 0.2, fits if learned else None, at_once)
    return _evaluate(preds, ["seasonal_naive", "own", "pooled", "transfer"], train, keys, value, horizons, season, per_region=False)


def mirror_test(load: DataFrame, keys: Sequence[str], ts: str, value: str, target: Column, horizons: Sequence[int] = (1, 24, 168), season: int = 24,
                dense: bool = False, at_once: int = 4, learned: bool = True, **params) -> dict[str, DataFrame]:
    """The same comparison on z-scores per region, with the forecasts turned back into units before scoring.

    Mean and deviation come from each region's training rows; p-values take the Student tail.
    """
    d = panel.with_hour_position(load, ts)
    split = splits.positional_split(d, keys, "pos", 0.7, 0.15) if dense else splits.chronological_split(d, keys, ts, F.col(ts).cast("date"), 0.7, 0.15)
    stats = cut_lineage(panel.group_stats(split.filter("split = 'train'"), keys, value))
    z = panel.zscore(load, keys, value, "z", stats).drop("mu", "sigma")
    # a region without deviation stays, at its mean
    z = z.withColumn("z", F.coalesce("z", F.lit(0.0))).filter(F.col(value).isNotNull())

    def fits(source, train, rest):
        only, base = learners.together([lambda: learners.fit_binned(train, "target", **params), lambda: learners.fit_binned(source, "target", **params)])
        return {"target_only": learners.predict_binned(only, rest), "source_only": learners.predict_binned(base, rest),
                "transfer": learners.residual_binned(base, train, "target", **params)(rest)}

    table = horizon_table(z.withColumn("raw", F.col(value)), keys, ts, "z", horizons, 0.7, 0.15, dense, season)
    preds, train = _study(table, keys, target, horizons, FEATURES, "raw", 0.7, 0.15, fits if learned else None, at_once)
    back = on_keys(preds, stats, keys).select(
        *keys, "ts", "pos", "split", "horizon", "model", *[panel.denormalize(F.col(c), F.col("mu"), F.coalesce("sigma", F.lit(0.0))).alias(c) for c in ("y_true", "y_pred")])
    return _evaluate(cut_lineage(back), ["seasonal_naive", "target_only", "source_only", "transfer"], train, keys, "raw", horizons, season,
                     per_region=True, tail="t")


def over_horizons(job: Callable[..., dict[str, DataFrame]], horizons: Sequence[int], *args, **params) -> dict[str, DataFrame]:
    """Scores and tests of ``train_and_evaluate`` or ``mirror_test`` at several horizons."""
    found = job(*args, horizons=horizons, **params)
    return {name: found[name] for name in ("metrics", "comparison")}


def walk_forward_compare(series: DataFrame, keys: Sequence[str], order: str, bucket: Column, value: str, horizon: int, season: int,
                         base: str = "persistence", holt: bool = True, save_to: str | None = None, folds: Column | None = None) -> dict[str, DataFrame]:
    """Expanding-window comparison of the closed-form models, with scores and tests against the base model.

    ``folds`` asks for the last so many folds of a series of ``n`` rows (see ``splits.recent_folds``), all of them unless given. ``plan`` has a row
    for every series: how many folds it has, or why none. With ``save_to`` the predictions replace those of the same series in a table
    partitioned by series.
    """
    s = cut_lineage(panel.with_row_index(series, keys, [order], bucket))
    sizes = cut_lineage(s.groupBy(*keys).agg(F.count("*").alias("n")))
    cut = splits.walk_forward_cutoffs(sizes, keys, "n", horizon, folds)
    preds = fc.walk_forward(s, cut, splits.fold_targets(cut, keys, horizon), keys, "idx", value, horizon, season, holt)
    if save_to:
        preds = cut_lineage(preds)
        replace_slice(preds, save_to, keys)
    last = cut.groupBy(*keys).agg(F.max("cutoff").alias("_last"))
    train = on_keys(s, last, keys).filter(F.col("idx") < F.col("_last")).drop("_last")
    scored = metrics.with_mase(metrics.score(preds, [*keys, "model"]), metrics.mase_scale(train, keys, "idx", value, 1), keys)
    models = ["persistence", "mean", "trend", "seasonal", *(["holt"] if holt else [])]
    errors = metrics.paired_errors(preds, [*keys, "fold", "step"], "model", "y_true", "y_pred", metrics.versus(models, base))
    # folds are the time axis of the test; each step is a series of its own
    dm = metrics.diebold_mariano(errors, [*keys, "model_a", "model_b"], ["step"], "fold", 1, "iid")
    return {"predictions": preds, "metrics": scored, "comparison": metrics.with_p_value(dm), "plan": splits.fold_plan(sizes, keys, "n", horizon, folds)}


def daily_cf_compare(daily: DataFrame, date: str, value: str, horizon: int, season: float = 365.25, p: int = 2, k: int = 3,
                     **params) -> dict[str, DataFrame]:
    """Daily capacity factors: persistence, mean, Holt, harmonic autoregression and the residual hybrid on the last days."""
    key = ["series"]
    s = panel.with_row_index(daily.withColumn("series", F.lit("cf")), key, [date], F.trunc(date, "month"), total="_n")
    s = cut_lineage(s)
    train = s.filter(F.col("idx") < F.col("_n") - horizon)
    cut = fc.single_cutoff(train, key, F.count("*"))
    targets = splits.fold_targets(cut, key, horizon)
    base = fc.naive_forecasts(train, cut, targets, key, "idx", value, 1, ["persistence", "mean"])
    holt = fc.holt_forecast(fc.holt_search(fc.holt_states(train, cut, key, "idx", value), key), key, horizon)
    ar = fc.ar_fourier_forecast(fc.fit_ar_fourier(train, key, "idx", value, p, k, season), key, horizon, p, k, season)
    hybrid = learners.residual_hybrid(train, key, "idx", value, k, season, p, horizon, **params)
    preds = fc.with_actuals(splits.union_all(base, holt, ar, hybrid), s, key, "idx", value)
    preds = cut_lineage(preds)
    scored = metrics.with_mase(metrics.score(preds, [*key, "model"]), metrics.mase_scale(train, key, "idx", value, 365), key)
    models = ["persistence", "mean", "holt", "ar_fourier", "hybrid"]
    errors = metrics.paired_errors(preds, [*key, "idx"], "model", "y_true", "y_pred", metrics.versus(models, "persistence"))
    dm = metrics.with_p_value(metrics.diebold_mariano(errors, ["model_a", "model_b"], key, "idx", 1, "iid"))
    return {"predictions": preds, "metrics": scored, "comparison": dm}
