"""Forecast scores and forecast comparison tests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.joins import on_keys
from wattframe.functions.tails import p_value
from wattframe.operators.panel import over_chunks


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def mae(y, p) -> Column:
    return F.avg(F.abs(_c(y) - _c(p)))


def rmse(y, p) -> Column:
    e = _c(y) - _c(p)
    return F.sqrt(F.avg(e * e))


def smape(y, p, floor: float | None = None) -> Column:
    """Percent; pairs of zeros are skipped, or counted as no error when a denominator ``floor`` is given."""
    size = F.abs(_c(y)) + F.abs(_c(p))
    err = 2 * F.abs(_c(y) - _c(p))
    if floor is not None:
        return 100 * F.avg(err / F.greatest(size, F.lit(2 * floor)))
    return 100 * F.avg(F.when(size > 0, err / size))


def r2(y, p) -> Column:
    e = _c(y) - _c(p)
    spread = F.var_pop(_c(y)) * F.count(_c(y))
    return 1 - F.sum(e * e) / F.when(spread > 0, spread)


def pinball(y, p, q: float) -> Column:
    e = _c(y) - _c(p)
    return F.avg(F.greatest(q * e, (q - 1) * e))


def picp(y, lo, hi) -> Column:
    """Percent of actuals inside the band."""
    return 100 * F.avg(F.when(_c(y).between(_c(lo), _c(hi)), 1.0).otherwise(0.0))


def score(df: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred", lo: str | None = None,
          hi: str | None = None, qs: Sequence[float] = (0.05, 0.95)) -> DataFrame:
    """All scores per group in one aggregate."""
    aggs = [F.count("*").alias("n"), mae(y, p).alias("mae"), rmse(y, p).alias("rmse"), smape(y, p).alias("smape_pct"),
            r2(y, p).alias("r2")]
    if lo and hi:
        aggs += [picp(y, lo, hi).alias("picp_pct"), pinball(y, lo, qs[0]).alias("pinball_lo"),
                 pinball(y, hi, qs[1]).alias("pinball_hi")]
    return df.groupBy(*by).agg(*aggs)


def mase_scale(train: DataFrame, keys: Sequence[str], pos: str, y: str, season: int, dense: bool = False) -> DataFrame:
    """keys, mase_scale, mase_season: the mean absolute difference of the training rows to those one season before.

    A series not longer than the season takes differences of 1 row instead; ``mase_season`` says which it took.
    """
    def build(w):
        return [F.abs(F.col(y) - F.lag(y, s).over(w)).alias(f"_d{s}") for s in {season, 1}]

    d = over_chunks(train, keys, pos, build, back=season, dense=dense)
    longer = F.count("*") > season
    scale = F.when(longer, F.avg(f"_d{season}")).otherwise(F.avg("_d1"))
    used = d.groupBy(*keys).agg(scale.alias("_s"), F.when(longer, season).otherwise(1).alias("mase_season"))
    return used.select(*keys, F.when(F.col("_s") > 0, F.col("_s")).alias("mase_scale"), "mase_season")


def with_mase(scores: DataFrame, scale: DataFrame, keys: Sequence[str], season: bool = False) -> DataFrame:
    """``scores`` with mase, and with the season of its scale if asked for."""
    found = on_keys(scores, scale, keys, "left").withColumn("mase", F.col("mae") / F.col("mase_scale")).drop("mase_scale")
    return found if season else found.drop("mase_season")


# --- comparison of two forecasts --------------------------------------------------------------------------

def paired_errors(preds: DataFrame, at: Sequence[str], model: str, y: str, p: str,
                  pairs: Sequence[tuple[str, str]]) -> DataFrame:
    """Errors of both models of each listed pair at each point: one grouping, no self-join."""
    names = sorted({m for ab in pairs for m in ab})
    e = F.col(y) - F.col(p)
    wide = preds.groupBy(*at).agg(*[F.max(F.when(F.col(model) == m, e)).alias(f"_e{i}") for i, m in enumerate(names)])
    rows = F.array(*[F.struct(F.lit(a).alias("model_a"), F.lit(b).alias("model_b"),
                              F.col(f"_e{names.index(a)}").alias("e_a"), F.col(f"_e{names.index(b)}").alias("e_b"))
                     for a, b in pairs])
    return (wide.select(*at, F.inline(rows)).filter(F.col("e_a").isNotNull() & F.col("e_b").isNotNull()))


def all_pairs(models: Sequence[str]) -> list[tuple[str, str]]:
    ms = sorted(models)
    return [(a, b) for i, a in enumerate(ms) for b in ms[i + 1:]]


def versus(models: Sequence[str], base: str) -> list[tuple[str, str]]:
    return [(m, base) for m in sorted(models) if m != base]


def diebold_mariano(errors: DataFrame, by: Sequence[str], series: Sequence[str], pos: str, horizon: int = 1,
                    variance: str = "flat", hln: bool = True, min_rows: int = 8, floor: float = 1e-12) -> DataFrame:
    """DM statistic of squared-error differences per ``by`` group; negative means the first model is better.

    ``variance``: iid, flat (plain sum of autocovariances up to horizon - 1) or bartlett. Lags stay inside a
    series. The lag products are made inside the task and folded before the shuffle.
    """
    d = errors.withColumn("_d", F.col("e_a") * F.col("e_a") - F.col("e_b") * F.col("e_b"))
    base = d.groupBy(*by).agg(F.count("*").alias("n"), F.avg("_d").alias("_mean"), F.var_samp("_d").alias("_var"),
                              F.var_pop("_d").alias("_g0"))
    out = base
    if variance != "iid" and horizon > 1:
        centred = on_keys(d, base.select(*by, "_mean"), by).withColumn("_x", F.col("_d") - F.col("_mean"))
        keys = [*by, *[s for s in series if s not in by]]
        past = over_chunks(centred, keys, pos, lambda w: [
            F.collect_list("_x").over(w.rowsBetween(-(horizon - 1), 0)).alias("_past")], back=horizon - 1)
        lagged = (past.select(*by, "_x", F.posexplode(F.reverse("_past")).alias("_k", "_xk")).filter("_k > 0"))
        cov = lagged.groupBy(*by, "_k").agg(F.covar_samp("_x", "_xk").alias("_cs"), F.sum(F.col("_x") * F.col("_xk")).alias("_cp"))
        if variance == "flat":
            extra = cov.groupBy(*by).agg((2 * F.sum("_cs")).alias("_extra"))
        else:
            extra = cov.groupBy(*by).agg((2 * F.sum((1 - F.col("_k") / horizon) * F.col("_cp"))).alias("_extra"))
        out = on_keys(base, extra, by, "left")
    else:
        out = out.withColumn("_extra", F.lit(0.0))
    n, h = F.col("n"), horizon
    extra = F.coalesce("_extra", F.lit(0.0))
    if variance == "bartlett":
        v = F.col("_g0") + extra / n
        v = F.when(v > 0, v)
    elif variance == "flat":
        v = F.greatest(F.col("_var") + extra, F.lit(floor))
    else:
        v = F.when(F.col("_var") > 0, F.col("_var"))
    stat = F.col("_mean") / F.sqrt(v / n)
    if hln:
        stat = stat * F.sqrt(F.greatest((n + 1 - 2 * h + h * (h - 1) / n) / n, F.lit(0.0)))
    return out.select(*by, "n", F.when(n >= min_rows, stat).alias("dm_stat"))


def with_p_value(tests: DataFrame, distribution: str = "normal") -> DataFrame:
    """Two-sided p-value per test row; Student t uses n - 1 degrees of freedom."""
    nu = (F.col("n") - 1) if distribution == "t" else None
    return tests.withColumn("p_value", p_value("dm_stat", nu))
