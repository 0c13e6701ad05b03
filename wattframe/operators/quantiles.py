"""Exact order statistics without gathering a group in one task.

Equal values are first folded into (value, count). A mergeable sketch then gives split points, the counts per
slice locate the ranks wanted, and only the slices that hold them are sorted. The sketch affects balance only:
the result is the exact linear-interpolation quantile.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wattframe.joins import on_keys
from wattframe.session import cut_lineage

LEAST_STEP = 8


def _step(df: DataFrame) -> int:
    """Square root of the number of slices: four for each shuffle partition of the cluster, 64 at least."""
    return max(LEAST_STEP, math.ceil(math.sqrt(4 * int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))))


def _slice_number(value: str, bounds: Column, coarse: Column, step: int) -> Column:
    """Number of sorted bounds below the value, by a coarse pass over every ``step``-th bound and one inside the step."""
    x = F.col(value)
    i = F.size(F.filter(coarse, lambda b: b < x)) * step
    return i + F.size(F.filter(F.slice(bounds, i + 1, step), lambda b: b < x))


def sliced_values(df: DataFrame, keys: Sequence[str], value: str, stored: bool = False) -> tuple[DataFrame, DataFrame]:
    """Distinct values with counts and a slice number, and per (group, slice) the rows in it, before it and in all.

    The split points are those of the whole value range, one array for all groups, so tagging needs no join and no
    (group, slice) is larger than a slice of the range. The tagged table is saved in the checkpoint folder before its
    slices are counted: a float that is computed twice may differ in its last bit, and counts and rows have to agree.
    ``stored`` says that the value is a column of a stored table or made of one row of it, so it can't differ: nothing is saved.
    """
    step = _step(df)
    slices = step * step
    vals = df.filter(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count("*").alias("c"))
    probes = F.lit([i / slices for i in range(1, slices)])
    cuts = vals.agg(F.array_distinct(F.percentile_approx(value, probes, F.lit(10_000))).alias("cuts")).select(
        F.struct("cuts", F.filter("cuts", lambda b, i: i % step == step - 1).alias("coarse")))
    number = _slice_number(value, F.col("_s.cuts"), F.col("_s.coarse"), step).alias("slice")
    tagged = vals.withColumn("_s", cuts.scalar()).select(*keys, value, "c", number)
    tagged = tagged if stored else cut_lineage(tagged)
    sizes = tagged.groupBy(*keys, "slice").agg(F.sum("c").alias("_rows"))
    w = W.partitionBy(*keys).orderBy("slice")
    return tagged, sizes.select(
        *keys, "slice", "_rows", F.coalesce(F.sum("_rows").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("off"),
        F.sum("_rows").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n"))


def order_statistics(df: DataFrame, keys: Sequence[str], value: str, ranks: dict[str, Callable[[Column], Column]], stored: bool = False) -> DataFrame:
    """Values at fractional 0-based ranks per group; each entry maps the group size to a rank."""
    tagged, slices = sliced_values(df, keys, value, stored)
    rank = {name: fn(F.col("n")) for name, fn in ranks.items()}
    hit = F.lit(False)
    for r in [r for x in rank.values() for r in (F.floor(x), F.ceil(x))]:
        hit = hit | ((r >= F.col("off")) & (r < F.col("off") + F.col("_rows")))
    w = W.partitionBy(*keys, "slice").orderBy(value).rowsBetween(W.unboundedPreceding, 0)
    picked = on_keys(tagged, slices.filter(hit), [*keys, "slice"]).withColumn("_end", F.col("off") + F.sum("c").over(w))

    def at(r):
        return F.max(F.when((r < F.col("_end")) & (r >= F.col("_end") - F.col("c")), F.col(value)))

    aggs = []
    for name, x in rank.items():
        aggs += [at(F.floor(x)).alias(f"_lo_{name}"), at(F.ceil(x)).alias(f"_hi_{name}")]
    got = picked.groupBy(*keys).agg(F.max("n").alias("n"), *aggs)
    out = []
    for name, x in rank.items():
        lo, hi = F.col(f"_lo_{name}"), F.col(f"_hi_{name}")
        out.append((lo + (hi - lo) * (x - F.floor(x))).alias(name))
    return got.select(*keys, "n", *out)


def quantiles(df: DataFrame, keys: Sequence[str], value: str, probs: dict[str, float], stored: bool = False) -> DataFrame:
    """Linear-interpolation quantiles per group; ``probs`` maps a result column to its level."""
    return order_statistics(df, keys, value, {name: (lambda n, p=p: F.lit(float(p)) * (n - 1)) for name, p in probs.items()}, stored)


def cumulative_share(df: DataFrame, keys: Sequence[str], value: str, stored: bool = False) -> DataFrame:
    """Per distinct value: how many rows are at or above it, and their share of the group (exceedance)."""
    tagged, slices = sliced_values(df, keys, value, stored)
    s = on_keys(tagged, slices, [*keys, "slice"])
    w = W.partitionBy(*keys, "slice").orderBy(value).rowsBetween(W.unboundedPreceding, -1)
    below = F.col("off") + F.coalesce(F.sum("c").over(w), F.lit(0))
    return (s.withColumn("_below", below)
            .select(*keys, value, F.col("c").alias("n_equal"), (F.col("n") - F.col("_below")).alias("n_at_or_above"),
                    ((F.col("n") - F.col("_below")) / F.col("n")).alias("share_exceeded")))


def with_rank(df: DataFrame, keys: Sequence[str], value: str, name: str = "rank", ascending: bool = False, stored: bool = False) -> DataFrame:
    """SQL ``rank()`` by value inside the group, without sorting the group in one task.

    Ranks are joined back on the value, so the table is saved first, once, unless it is ``stored``: the value must not be computed twice.
    """
    df = df if stored else cut_lineage(df)
    c = cumulative_share(df, keys, value, stored=True)
    totals = c.groupBy(*keys).agg(F.max("n_at_or_above").alias("_n")) if keys else None
    if ascending:
        below = (F.col("_n") if keys else c.agg(F.max("n_at_or_above")).scalar()) - F.col("n_at_or_above")
        c = (on_keys(c, totals, keys) if keys else c).withColumn(name, (below + 1).cast("bigint"))
    else:
        c = c.withColumn(name, (F.col("n_at_or_above") - F.col("n_equal") + 1).cast("bigint"))
    return on_keys(df, c.select(*keys, value, name), [*keys, value], "left").select(*df.columns, name)
