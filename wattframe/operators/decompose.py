"""Index decomposition, structural breaks, multi-criteria ranking and projections."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wattframe.joins import on_keys
from wattframe.operators.panel import with_running_sums
from wattframe.operators.quantiles import with_rank

TINY = 1e-12


def log_mean(a: Column, b: Column) -> Column:
    return F.when(F.abs(a - b) < 1e-15 * F.greatest(F.abs(a), F.abs(b)), a).otherwise((b - a) / F.ln(b / a))


def _effects(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Effects per part from g0, c0, g1, c1, their totals gt0, gt1 and the small values dg, dc."""
    g0, g1 = F.greatest("g0", "dg"), F.greatest("g1", "dg")
    c0, c1 = F.greatest("c0", "dc"), F.greatest("c1", "dc")
    weight = log_mean(c0, c1)
    return df.select(*keys, (weight * F.ln(F.col("gt1") / F.col("gt0"))).alias("activity"),
                     (weight * F.ln((g1 / F.col("gt1")) / (g0 / F.col("gt0")))).alias("structure"),
                     (weight * F.ln((c1 / g1) / (c0 / g0))).alias("intensity"),
                     (F.col("c1") - F.col("c0")).alias("delta"))


def lmdi(df: DataFrame, part: str, year: str, activity: str, carbon: str, base: int, target: int) -> DataFrame:
    """Additive log-mean decomposition per part between two years; the effects add to the change."""
    yr = F.col(year)
    two = df.filter(yr.isin(base, target)).groupBy(part).agg(*[
        F.coalesce(F.sum(F.when(yr == y, F.col(c))), F.lit(0.0)).alias(n)
        for n, y, c in (("g0", base, activity), ("g1", target, activity), ("c0", base, carbon), ("c1", target, carbon))])
    two = two.filter((F.col("g0") + F.col("g1") + F.col("c0") + F.col("c1")) > 0)
    totals = two.agg(F.struct(F.sum("g0").alias("gt0"), F.sum("g1").alias("gt1"),
                              (TINY * F.greatest(F.max("g0"), F.max("g1"))).alias("dg"),
                              (TINY * F.greatest(F.max("c0"), F.max("c1"))).alias("dc")))
    d = two.withColumn("_t", totals.scalar()).select("*", "_t.*")
    return _effects(d, [part])


def lmdi_chain(df: DataFrame, part: str, year: str, activity: str, carbon: str) -> DataFrame:
    """Decomposition of every pair of consecutive years, with cumulated effects.

    A part missing in one of the years counts as zero. Years are few, so the running sums are a small window.
    """
    now = df.groupBy(F.col(part).alias("part"), F.col(year).alias("yr")).agg(
        F.sum(activity).alias("g1"), F.sum(carbon).alias("c1"))
    before = now.select("part", (F.col("yr") + 1).alias("yr"), F.col("g1").alias("g0"), F.col("c1").alias("c0"))
    ends = now.agg(F.struct(F.min("yr").alias("a"), F.max("yr").alias("z")))
    j = (on_keys(now, before, ["part", "yr"], "full").withColumn("_e", ends.scalar())
         .filter((F.col("yr") > F.col("_e.a")) & (F.col("yr") <= F.col("_e.z"))).drop("_e")
         .na.fill(0.0, ["g0", "g1", "c0", "c1"]))
    tot = j.groupBy("yr").agg(F.sum("g0").alias("gt0"), F.sum("g1").alias("gt1"),
                              (TINY * F.greatest(F.max("g0"), F.max("g1"))).alias("dg"),
                              (TINY * F.greatest(F.max("c0"), F.max("c1"))).alias("dc"))
    e = _effects(on_keys(j, tot, ["yr"]).filter("gt0 > 0 and gt1 > 0"), ["yr"])
    names = ("activity", "structure", "intensity", "delta")
    per_year = e.groupBy("yr").agg(*[F.sum(n).alias(n) for n in names])
    w = W.orderBy("yr").rowsBetween(W.unboundedPreceding, 0)
    return per_year.select("yr", *names, *[F.sum(n).over(w).alias(f"cum_{n}") for n in names])


def sup_f(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, value: str, trim: int = 2) -> DataFrame:
    """Largest F over single mean breaks: last row of the first regime, F, and both means; ties to the earliest."""
    totals = df.groupBy(*keys).agg(F.count("*").alias("_n"), F.avg(value).alias("_m"), F.var_pop(value).alias("_v"))
    d = on_keys(df, totals, keys)
    # centred values keep the prefix sums of squares exact enough for long series
    d = d.withColumn("_x", F.col(value) - F.col("_m"))
    run = with_running_sums(d, keys, [order], bucket, {"_k": F.lit(1), "_s": F.col("_x"), "_q": F.col("_x") * F.col("_x")})
    n, k, s, q = (F.col(c) for c in ("_n", "_k", "_s", "_q"))
    ssr0 = F.col("_v") * n
    left = q - s * s / k
    right = (ssr0 - q) - s * s / (n - k)  # centred: the second sum is minus the first
    ssr1 = left + right
    f = (ssr0 - ssr1) / (ssr1 / (n - 2))
    cand = run.filter((k >= trim) & (k <= n - trim) & (n > 2)).select(
        *keys, k.cast("bigint").alias("_at_k"), F.col(order).alias("_at"), F.when(ssr1 > 0, f).alias("_f"),
        (F.col("_m") + s / k).alias("mean_before"), (F.col("_m") - s / (n - k)).alias("mean_after"))
    best = F.max_by(F.struct("_at_k", "_at", "_f", "mean_before", "mean_after"), F.struct(F.col("_f"), (-F.col("_at_k")).alias("_k")))
    return (cand.groupBy(*keys).agg(best.alias("_b"))
            .select(*keys, F.col("_b._at").alias("break_at"), F.col("_b._at_k").alias("n_before"), F.col("_b._f").alias("sup_f"),
                    F.col("_b.mean_before").alias("mean_before"), F.col("_b.mean_after").alias("mean_after")))


class _Rivals:
    """Last breaks that can still win, each with the range of segment means for which its partition is the cheapest.

    A break's cost is a parabola in the mean of its last segment, and all of them grow alike with every new row. So a break that
    another one beats at a mean is beaten there for ever, and one that is left without a range is dropped: the search stays exact.
    """

    def __init__(self, lo: float, hi: float):
        self.lo, self.hi, self.at = np.array([lo]), np.array([hi]), np.array([-1])

    def add(self, at: int, best: np.ndarray, s: np.ndarray, q: np.ndarray) -> None:
        old = self.at
        if old[0] < 0:
            self.at = np.array([at])
            return
        # old less new is a parabola that opens upwards: the old break holds out between its roots
        a, b = (at - old).astype(float), s[at] - s[old]
        c = q[at] - q[old] + best[old] - best[at]
        inside = b * b - a * c
        root = np.sqrt(np.maximum(inside, 0.0))
        left = np.where(inside >= 0, np.clip((b - root) / a, self.lo, self.hi), self.hi)
        right = np.where(inside >= 0, np.clip((b + root) / a, left, self.hi), self.hi)
        lo, hi = np.stack([self.lo, left, right], 1).ravel(), np.stack([left, right, self.hi], 1).ravel()
        kept = np.stack([np.full(len(old), at), old, np.full(len(old), at)], 1).ravel()
        wide = hi > lo
        lo, hi, kept = lo[wide], hi[wide], kept[wide]
        first = np.concatenate([[True], kept[1:] != kept[:-1]])
        self.lo, self.at = lo[first], kept[first]
        self.hi = np.append(self.lo[1:], hi[-1])


def _best_partition(y: np.ndarray, m: int, trim: int) -> list[int]:
    """Sizes of the first segments of the least-squares partition into m + 1 segments of ``trim`` rows or more.

    An exact search over last breaks, of which only those stay that can still win: some dozen at a time, whatever the length.
    """
    n = len(y)
    x = y - y.mean() if n else y
    s, q = np.concatenate([[0.0], np.cumsum(x)]), np.concatenate([[0.0], np.cumsum(x * x)])
    size = np.arange(n + 1)
    best = np.where(size >= max(trim, 1), q - s * s / np.maximum(size, 1), np.inf)
    back = []
    for _ in range(m):
        nxt, arg = np.full(n + 1, np.inf), np.zeros(n + 1, dtype=int)
        rivals, known = _Rivals(x.min() - 1.0, x.max() + 1.0) if n else None, False
        for j in range(2 * trim, n + 1):
            if np.isfinite(best[j - trim]):
                rivals.add(j - trim, best, s, q)
                known = True
            if known:
                i = rivals.at
                c = best[i] + (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (j - i)
                k = int(c.argmin())
                nxt[j], arg[j] = c[k], i[k]
        best = nxt
        back.append(arg)
    cuts, j = [], n
    for arg in reversed(back):
        j = int(arg[j])
        cuts.append(j)
    return cuts[::-1] if np.isfinite(best[n]) else []


def multi_break(df: DataFrame, keys: Sequence[str], period: str, value: str, breaks: int, trim: int = 2) -> DataFrame:
    """Best partition of each series into ``breaks`` + 1 mean segments.

    Rows are first summed to one per (series, period), so a group holds one row per calendar period however many rows the table has. The
    search of a series is one task; its time grows about in proportion to the periods. A NULL key is a series of its own; a series too
    short for the segments gives no rows.
    """
    per = df.groupBy(*keys, period).agg(F.sum(value).cast("double").alias("_y"))

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(period)
        cuts = _best_partition(pdf["_y"].to_numpy(), breaks, trim)
        head = {k: pdf[k].iloc[:1].repeat(len(cuts)).to_numpy(dtype=object) for k in keys}
        return pd.DataFrame({**head, "break_no": range(1, len(cuts) + 1), "n_before": cuts,
                             "last_period": pdf[period].iloc[[c - 1 for c in cuts]].to_numpy(dtype=object)})

    kinds = dict(per.dtypes)
    schema = ", ".join([*[f"{k} {kinds[k]}" for k in keys], "break_no int", "n_before int", f"last_period {kinds[period]}"])
    return per.groupBy(*keys).applyInPandas(solve, schema)


# --- ranking ----------------------------------------------------------------------------------------------

def to_matrix(df: DataFrame, alternative: str, criteria: Sequence[str]) -> DataFrame:
    """Wide alternatives to (alternative, criterion, x)."""
    wide = df.select(alternative, *[F.col(c).cast("double").alias(c) for c in criteria])
    return wide.unpivot([alternative], list(criteria), "criterion", "x")


def topsis(matrix: DataFrame, alternative: str, weights: Mapping[str, float], benefit: Mapping[str, bool]) -> DataFrame:
    """Closeness to the ideal alternative and rank, from (alternative, criterion, x)."""
    total = sum(weights.values())
    w = F.create_map(*[F.lit(z) for k, v in weights.items() for z in (k, v / total)])
    up = F.create_map(*[F.lit(z) for k, v in benefit.items() for z in (k, v)])
    norms = matrix.groupBy("criterion").agg(F.sqrt(F.sum(F.col("x") * F.col("x"))).alias("_n"), F.max("x").alias("_hi"), F.min("x").alias("_lo"))
    scale = w[F.col("criterion")] / F.when(F.col("_n") > 0, F.col("_n"))
    ideal = F.when(up[F.col("criterion")], F.col("_hi")).otherwise(F.col("_lo"))
    worst = F.when(up[F.col("criterion")], F.col("_lo")).otherwise(F.col("_hi"))
    d = matrix.join(norms, "criterion").select(
        alternative, (F.coalesce(scale, F.lit(0.0)) * (F.col("x") - ideal)).alias("_p"),
        (F.coalesce(scale, F.lit(0.0)) * (F.col("x") - worst)).alias("_m"))
    c = d.groupBy(alternative).agg(F.sqrt(F.sum(F.col("_p") * F.col("_p"))).alias("d_plus"),
                                   F.sqrt(F.sum(F.col("_m") * F.col("_m"))).alias("d_minus"))
    both = F.col("d_plus") + F.col("d_minus")
    c = c.withColumn("closeness", F.col("d_minus") / F.when(both > 0, both))
    return with_rank(c, [], "closeness")


def weighted_score(matrix: DataFrame, alternative: str, weights: Mapping[str, float]) -> DataFrame:
    """Sum of weight times score per alternative, ranked."""
    w = F.create_map(*[F.lit(z) for kv in weights.items() for z in kv])
    s = (matrix.filter(F.col("criterion").isin(*weights)).groupBy(alternative)
         .agg(F.sum(w[F.col("criterion")] * F.col("x")).alias("score")))
    return with_rank(s, [], "score")


# --- projections ------------------------------------------------------------------------------------------

def scenario_projection(base: DataFrame, keys: Sequence[str], year: str, value: str,
                        scenarios: Sequence[tuple[str, float, int]]) -> DataFrame:
    """Linear path from each base value to factor x base by the target year, with gap and yearly need."""
    table = F.array(*[F.struct(F.lit(n).alias("scenario"), F.lit(float(f)).alias("_f"), F.lit(t).alias("_t")) for n, f, t in scenarios])
    b = base.select(*keys, F.col(year).alias("_y0"), F.col(value).alias("_v0"), F.inline(table)).filter("_t > _y0")
    gap = F.col("_v0") * (F.col("_f") - 1)
    need = gap / (F.col("_t") - F.col("_y0"))
    return (b.select(*keys, "scenario", "_y0", "_v0", gap.alias("gap"), need.alias("annual_need"),
                     F.explode(F.sequence(F.col("_y0"), F.col("_t"))).alias("year"))
            .select(*keys, "scenario", F.col("year").cast("int").alias("year"),
                    (F.col("_v0") + F.col("annual_need") * (F.col("year") - F.col("_y0"))).alias("projected"), "gap", "annual_need"))


def cagr(first: Column, last: Column, years: Column | int) -> Column:
    ratio = F.when((first > 0) & (last > 0), last / first)
    return F.pow(ratio, F.lit(1.0) / years) - 1
