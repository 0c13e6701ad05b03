"""Data-quality checks. Each gives rows (check_name, item, severity, detail), rolled up by :func:`verdict`."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.joins import on_keys

SEVERITY = {"pass": 0, "warn": 1, "fail": 2}


def _verdict_row(name: str, item: Column, bad: Column, detail: Column, on_bad: str = "fail") -> list[Column]:
    return [F.lit(name).alias("check_name"), item.cast("string").alias("item"),
            F.when(bad, on_bad).otherwise("pass").alias("severity"), detail.cast("string").alias("detail")]


def all_of(parts: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b), parts)


def row_floors(tables: Mapping[str, DataFrame | None], floors: Mapping[str, int]) -> DataFrame:
    """Each required table must exist (not None) and hold its minimum of rows."""
    spark = next(df for df in tables.values() if df is not None).sparkSession
    parts = []
    for name, low in floors.items():
        df = tables.get(name)
        counted = (df.agg(F.count("*").alias("n")) if df is not None else spark.range(1).select(F.lit(-1).cast("bigint").alias("n")))
        parts.append(counted.select(*_verdict_row("row_floor", F.lit(name), F.col("n") < low, F.col("n"))))
    return all_of(parts)


def slice_parity(source: DataFrame, target: DataFrame, on: Sequence[str], value: str, tol: float = 1.0) -> DataFrame:
    """Row counts and sums per slice of two copies of a table; sums may differ by less than ``tol``."""
    def totals(df, side):
        return df.groupBy(*on).agg(F.count("*").alias(f"rows_{side}"), F.coalesce(F.sum(value), F.lit(0.0)).alias(f"sum_{side}"))

    j = on_keys(totals(source, "source"), totals(target, "target"), on, "full")
    delta = F.abs(F.coalesce("sum_source", F.lit(0.0)) - F.coalesce("sum_target", F.lit(0.0)))
    same = F.col("rows_source").eqNullSafe(F.col("rows_target")) & (delta < tol)
    return j.withColumn("delta", delta).withColumn("ok", same)


def parity_check(compared: DataFrame, on: Sequence[str]) -> DataFrame:
    """Verdict rows from :func:`slice_parity`."""
    return compared.select(*_verdict_row("parity", F.concat_ws("/", *[F.col(c).cast("string") for c in on]), ~F.col("ok"),
                                         F.round("delta", 2)))


def acceptance(df: DataFrame, value: Column, expected: float, item: str, tol: float = 1.0) -> DataFrame:
    """One aggregate value within ``tol`` of a constant."""
    got = df.agg(value.alias("v"))
    bad = F.col("v").isNull() | (F.abs(F.col("v") - expected) >= tol)
    return got.select(*_verdict_row("acceptance", F.lit(item), bad, F.round("v", 2)))


def fact_parity_check(parity: DataFrame, keys: Sequence[str]) -> DataFrame:
    """One verdict row per compared fact: a difference fails, a fact that only one side has warns."""
    status = F.col("status")
    severity = F.when(status == "match", "pass").when(status == "differs", "fail").otherwise("warn")
    return parity.select(F.lit("fact_parity").alias("check_name"), F.concat_ws("/", *[F.col(k).cast("string") for k in keys]).alias("item"),
                         severity.alias("severity"), status.alias("detail"))


def audit_check(audit: DataFrame, keys: Sequence[str], confirmed: str) -> DataFrame:
    """One verdict row per audited fact: what no source confirms within the tolerance warns."""
    return audit.select(*_verdict_row("audit", F.concat_ws("/", *[F.col(k).cast("string") for k in keys]), ~F.col(confirmed), F.col(confirmed), "warn"))


def metric_realism(metrics: DataFrame, tests: DataFrame) -> DataFrame:
    """0 < sMAPE < 200 and MASE > 0 for every model; comparison rows not all degenerate (0, 1)."""
    smape, mase = F.col("smape_pct"), F.col("mase")
    m = metrics.agg(F.count_if(F.coalesce((smape <= 0) | (smape >= 200), F.lit(True))).alias("s"),
                    F.count_if(F.coalesce(mase <= 0, F.lit(True))).alias("m"))
    zero = (F.col("dm_stat") == 0) & (F.col("p_value") == 1)
    t = tests.agg(F.count_if(zero).alias("z"), F.count("*").alias("n"))
    return all_of([
        m.select(*_verdict_row("realism", F.lit("smape"), F.col("s") > 0, F.col("s"))),
        m.select(*_verdict_row("realism", F.lit("mase"), F.col("m") > 0, F.col("m"))),
        t.select(F.lit("realism").alias("check_name"), F.lit("comparison").alias("item"),
                 F.when((F.col("z") == F.col("n")) & (F.col("n") > 0), "fail").when(F.col("z") > 0, "warn").otherwise("pass").alias("severity"),
                 F.col("z").cast("string").alias("detail"))])


def null_counts(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    one = df.agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in cols])
    return one.unpivot([], list(cols), "column_name", "n_null")


def null_check(df: DataFrame, cols: Sequence[str]) -> DataFrame:
    return null_counts(df, cols).select(*_verdict_row("nulls", F.col("column_name"), F.col("n_null") > 0, F.col("n_null")))


def completeness_check(df: DataFrame, keys: Sequence[str], ts: str, expected: int = 24) -> DataFrame:
    """Groups (keys, day) without ``expected`` rows, counted into one verdict row."""
    days = df.groupBy(*keys, F.col(ts).cast("date").alias("_d")).agg(F.count("*").alias("_n"))
    bad = days.agg(F.count_if(F.col("_n") != expected).alias("n"))
    return bad.select(*_verdict_row("completeness", F.lit("+".join(keys)), F.col("n") > 0, F.col("n")))


def cleaning_report(df: DataFrame, keys: Sequence[str], raw_time: str, parsed_time: str, values: Sequence[str]) -> DataFrame:
    """Before, blank, bad time, duplicate, kept and missing-hour counts from flags instead of successive drops."""
    blank = F.coalesce(*[F.col(c).cast("string") for c in values]).isNull()
    good = ~blank & F.col(parsed_time).isNotNull()
    flags = df.groupBy(*keys).agg(
        F.count("*").alias("n_before"), F.count_if(blank).alias("n_blank"),
        F.count_if(~blank & F.col(parsed_time).isNull()).alias("n_bad_time"), F.count_if(good).alias("_good"))
    per_time = df.filter(good).groupBy(*keys, parsed_time).agg(F.count("*").alias("_c"))
    times = per_time.groupBy(*keys).agg(F.count("*").alias("n_after"), F.min(parsed_time).alias("_a"), F.max(parsed_time).alias("_z"))
    span = F.timestamp_diff("HOUR", F.col("_a"), F.col("_z")) + 1
    return on_keys(flags, times, keys, "left").select(
        *keys, "n_before", "n_blank", "n_bad_time", (F.col("_good") - F.coalesce("n_after", F.lit(0))).alias("n_duplicates"),
        F.coalesce("n_after", F.lit(0)).alias("n_after"), F.coalesce(span - F.col("n_after"), F.lit(0)).alias("n_missing_hours"))


def coverage_counts(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n"))


def coverage_report(df: DataFrame, cells: Sequence[Sequence[str]], distinct: Sequence[str]) -> DataFrame:
    """Counts per column combination and distinct counts, as (section, item, n) rows."""
    parts = []
    for cols in cells:
        parts.append(coverage_counts(df, cols).select(
            F.lit("rows by " + ",".join(cols)).alias("section"),
            F.concat_ws("/", *[F.col(c).cast("string") for c in cols]).alias("item"), "n"))
    one = df.agg(*[F.count_distinct(c).alias(c) for c in distinct])
    parts.append(one.unpivot([], list(distinct), "item", "n").select(F.lit("distinct").alias("section"), "item", "n"))
    return all_of(parts)


def verdict(checks: DataFrame) -> DataFrame:
    """Overall status and the number of failures, warnings and passes."""
    s = F.col("severity")
    n = {k: F.count_if(s == k) for k in SEVERITY}
    status = F.when(n["fail"] > 0, "FAIL").when(n["warn"] > 0, "PASS WITH WARNINGS").otherwise("PASS")
    return checks.agg(status.alias("status"), n["fail"].alias("n_fail"), n["warn"].alias("n_warn"), n["pass"].alias("n_pass"))
