"""Table-level parts of the site study: cooling hours, sensitivities and cost sweeps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.functions import resource


def pue_by_month(df: DataFrame, keys: Sequence[str], ts: str, temp_c: str) -> DataFrame:
    """Mean efficiency per month and over all hours (month NULL), from one pass over the hours."""
    m = df.select(*keys, F.month(ts).alias("month"), resource.pue(temp_c).alias("_p"))
    return (m.groupingSets([[F.col(k) for k in (*keys, "month")], [F.col(k) for k in keys]], *keys, "month")
            .agg(F.avg("_p").alias("pue"), F.count("*").alias("hours")))


def cooling_hours(df: DataFrame, keys: Sequence[str], temp_c: str) -> DataFrame:
    mode = resource.cooling_mode(temp_c)
    n = F.count(temp_c)
    share = {m: F.count_if(mode == m) for m in ("free", "partial", "mechanical")}
    return df.groupBy(*keys).agg(*[c.alias(f"{m}_hours") for m, c in share.items()],
                                 *[(100 * c / n).alias(f"{m}_pct") for m, c in share.items()])


def threshold_sensitivity(df: DataFrame, keys: Sequence[str], temp_c: str, thresholds: Sequence[float]) -> DataFrame:
    """Share of hours below each threshold: conditional counts in one pass, then one row per threshold."""
    one = df.groupBy(*keys).agg(F.count(temp_c).alias("_n"), *[
        F.count_if(F.col(temp_c) < t).alias(f"_c{i}") for i, t in enumerate(thresholds)])
    rows = F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"_c{i}").alias("hours_below"),
                              (F.col(f"_c{i}") / F.col("_n")).alias("share_below")) for i, t in enumerate(thresholds)])
    return one.select(*keys, F.inline(rows))


def tariff_sweep(df: DataFrame, tariffs: Sequence[float], cost: Mapping[str, Column]) -> DataFrame:
    """Evaluate cost columns for every tariff of a literal list; ``cost`` may refer to the column ``tariff``."""
    swept = df.withColumn("tariff", F.explode(F.lit([float(t) for t in tariffs])))
    return swept.withColumns(dict(cost))


def linspace(lo: float, hi: float, n: int) -> list[float]:
    step = (hi - lo) / (n - 1)
    return [lo + i * step for i in range(n)]


def water_by_technology(df: DataFrame, kwh: str, table: Mapping[str, float] = resource.WATER_USE) -> DataFrame:
    """Water per cooling technology for each row's energy."""
    rows = F.array(*[F.struct(F.lit(k).alias("technology"), F.lit(v).alias("wue")) for k, v in table.items()])
    return df.select("*", F.inline(rows)).withColumn("water_l", resource.water_use("wue", kwh))
