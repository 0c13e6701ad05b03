"""Union, dedup, sampling, and time-ordered splits and folds."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.joins import on_keys
from wattframe.operators.panel import with_row_index


def union_all(*parts: DataFrame) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def keep_first(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """One row per key, the first in ``order``. A partial aggregate, so a key with many copies stays cheap."""
    return _keep(df, keys, order, F.min_by)


def keep_last(df: DataFrame, keys: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    return _keep(df, keys, order, F.max_by)


def _keep(df, keys, order, pick):
    rest = [c for c in df.columns if c not in keys]
    row = F.struct(*rest)
    got = df.groupBy(*keys).agg(pick(row, F.struct(*order)).alias("_r"))
    return got.select(*[F.col(c) if c in keys else F.col(f"_r.{c}").alias(c) for c in df.columns])


def set_difference(a: DataFrame, b: DataFrame, on: Sequence[str]) -> DataFrame:
    """Distinct keys of ``a`` that ``b`` lacks."""
    return a.select(*on).distinct().join(b.select(*on), list(on), "left_anti")


def capped_sample(df: DataFrame, keys: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """``n`` rows in the order of a seeded hash of the key, then back in key order. Repeats on every run."""
    h = F.md5(F.concat_ws("|", *[F.col(k).cast("string") for k in keys], F.lit(str(seed))))
    return df.withColumn("_h", h).orderBy("_h", *keys).limit(n).drop("_h").orderBy(*keys)


def chronological_split(df: DataFrame, keys: Sequence[str], order: str, bucket: Column, train: float = 0.6,
                        val: float = 0.2) -> DataFrame:
    """Label rows train, val or test by their place in the (per series) time order, cut at whole rows."""
    d = with_row_index(df, keys, [order], bucket, index="idx", total="n_rows")
    a = F.floor(F.col("n_rows") * F.lit(float(train)))
    b = F.floor(F.col("n_rows") * F.lit(float(train + val)))
    return d.withColumn("split", F.when(F.col("idx") < a, "train").when(F.col("idx") < b, "val").otherwise("test"))


def positional_split(df: DataFrame, keys: Sequence[str], pos: str, train: float = 0.6, val: float = 0.2) -> DataFrame:
    """``chronological_split`` of series whose ``pos`` counts rows without gaps: the place of a row follows from the ends of its series, so no
    rows are numbered. Adds idx, n_rows and split."""
    ends = df.groupBy(*keys).agg(F.min(pos).alias("_first"), (F.max(pos) - F.min(pos) + 1).alias("n_rows"))
    d = on_keys(df, ends, keys).withColumn("idx", F.col(pos) - F.col("_first")).drop("_first")
    a = F.floor(F.col("n_rows") * F.lit(float(train)))
    b = F.floor(F.col("n_rows") * F.lit(float(train + val)))
    return d.withColumn("split", F.when(F.col("idx") < a, "train").when(F.col("idx") < b, "val").otherwise("test"))


def date_split(df: DataFrame, date: str, cut: str) -> DataFrame:
    return df.withColumn("split", F.when(F.col(date) < F.lit(cut).cast("date"), "train").otherwise("test"))


def merge_train_val(df: DataFrame) -> DataFrame:
    return df.filter(F.col("split").isin("train", "val"))


def fold_plan(sizes: DataFrame, keys: Sequence[str], n: str, horizon: int, folds: Column | None = None, first: int = 3) -> DataFrame:
    """Per series its length, first cut-off, number of expanding-window folds, and why there are none.

    Every cut-off with at least ``first`` rows before it and ``horizon`` rows from it on is a fold; ``folds`` asks for the last so many.
    """
    size = F.col(n).cast("bigint")
    start = F.lit(first).cast("bigint") if folds is None else F.greatest(F.lit(first), size - folds - horizon + 1).cast("bigint")
    count = F.greatest(F.lit(0), size - horizon - start + 1).cast("bigint")
    return sizes.select(*keys, size.alias("n_rows"), start.alias("first_cutoff"), count.alias("n_folds"),
                        F.when(count == 0, "too short for one fold").alias("reason"))


def walk_forward_cutoffs(sizes: DataFrame, keys: Sequence[str], n: str, horizon: int, folds: Column | None = None, first: int = 3) -> DataFrame:
    """Cut-offs of the folds of ``fold_plan``, numbered from 0; series too short for one have a row there and none here."""
    plan = fold_plan(sizes, keys, n, horizon, folds, first).filter("n_folds > 0")
    return plan.select(*keys, F.posexplode(F.sequence(F.col("first_cutoff"), F.col("first_cutoff") + F.col("n_folds") - 1)).alias("fold", "cutoff"))


def recent_folds(n: str, share: float = 0.4, most: int = 12, least: int = 2) -> Column:
    """Number of folds for ``walk_forward_cutoffs``: a share of the series, between two bounds."""
    return F.greatest(F.lit(least), F.least(F.floor(F.col(n) * share), F.lit(most)))


def fold_targets(cutoffs: DataFrame, keys: Sequence[str], horizon: int) -> DataFrame:
    """(series, fold, cutoff, step, idx) rows to join with the series on idx."""
    steps = F.sequence(F.lit(1), F.lit(horizon))
    return (cutoffs.select(*keys, "fold", "cutoff", F.explode(steps).alias("step"))
            .withColumn("idx", (F.col("cutoff") + F.col("step") - 1).cast("bigint")))


def rolling_origin_folds(sizes: DataFrame, keys: Sequence[str], n: str, k: int, min_rows: int | None = None) -> DataFrame:
    """``k`` equal folds: fold i trains on rows before ``test_from`` and tests up to ``test_to`` (exclusive).

    A series with fewer than ``min_rows`` rows (k + 1 unless given) has one row with a reason instead.
    """
    least = F.lit(k + 1 if min_rows is None else max(min_rows, k + 1))
    size = F.floor(F.col(n) / (k + 1)).cast("bigint")
    fits = F.col(n) >= least
    numbers = F.when(fits, F.sequence(F.lit(1), F.lit(k))).otherwise(F.array(F.lit(None).cast("int")))
    rows = sizes.select(*keys, F.col(n), size.alias("_z"), F.explode(numbers).alias("fold"))
    return rows.select(*keys, "fold", (F.col(n) - (k - F.col("fold") + 1) * F.col("_z")).alias("test_from"),
                       (F.col(n) - (k - F.col("fold")) * F.col("_z")).alias("test_to"), F.when(F.col("fold").isNull(), "too few rows").alias("reason"))
