"""Monthly totals to hourly values."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wattframe.functions import calendar
from wattframe.operators.relational import median_ratio


def intraday_profile(df: DataFrame, ts: str, value: str) -> DataFrame:
    """Mean value per month, weekday and hour: at most 12 x 7 x 24 rows."""
    p = calendar.parts(ts)
    return (df.groupBy(*[p[n].alias(n) for n in ("month", "dow", "hour")]).agg(F.avg(value).alias("weight")))


def disaggregate(monthly: DataFrame, profile: DataFrame, total: str, keys: tuple[str, ...] = (),
                 year: str = "yr", month: str = "mo", name: str = "load_mw", factor: float = 1000.0) -> DataFrame:
    """Spread each month's total over its hours by profile weights.

    A missing weight falls back to the mean weight of that hour in the month, then to the month's mean; negative
    weights count as 0 and a month without positive weight is spread evenly. The month total is conserved.
    The hourly shares depend on the calendar month alone, so they are made once per month (at most 744 rows each)
    and then joined with however many totals there are.
    """
    months = monthly.select(year, month).distinct()
    parts = calendar.parts("ts")
    grid = calendar.month_hours(months, year, month).withColumns(
        {"_m": parts["month"], "dow": parts["dow"], "hour": parts["hour"]})
    prof = profile.select(F.col("month").alias("_m"), "dow", "hour", "weight")
    in_hour, in_month = W.partitionBy(year, month, "hour"), W.partitionBy(year, month)
    w = (grid.join(prof, ["_m", "dow", "hour"], "left").repartition(year, month)
         .withColumn("_w", F.coalesce("weight", F.avg("weight").over(in_hour)))
         .withColumn("_w", F.greatest(F.coalesce("_w", F.avg("_w").over(in_month), F.lit(0.0)), F.lit(0.0)))
         .withColumn("_s", F.sum("_w").over(in_month)).withColumn("_n", F.count("*").over(in_month)))
    share = F.when(F.col("_s") > 0, F.col("_w") / F.col("_s")).otherwise(1.0 / F.col("_n"))
    shares = w.select(year, month, "ts", share.alias("_share"))
    return (monthly.select(*keys, year, month, total).join(shares, [year, month])
            .select(*keys, year, month, "ts", (F.col("_share") * F.col(total) * factor).alias(name)))


def fallback_source(df: DataFrame, primary: str, secondary: str, name: str, tags: tuple[str, str]) -> DataFrame:
    """Primary value, else secondary times the median ratio, with the source named; rows with neither are dropped."""
    scale = F.coalesce(median_ratio(df, primary, secondary).select("ratio").scalar(), F.lit(1.0))
    return (df.withColumn(name, F.coalesce(F.col(primary), F.col(secondary) * scale))
            .withColumn("source", F.when(F.col(primary).isNotNull(), tags[0]).otherwise(tags[1]))
            .filter(F.col(name).isNotNull()))


def proxy_variables(df: DataFrame, wind_cf: str, solar_cf: str) -> DataFrame:
    """Wind speed and radiation proxies from capacity factors, with placeholders for what is not known."""
    def floored(c):
        return F.when(F.col(c).isNotNull(), F.greatest(F.col(c), F.lit(0.0)))

    return df.withColumns({
        "wind_speed_10m": floored(wind_cf) * 15.0,
        "shortwave_radiation": floored(solar_cf) * 1000.0,
        "temperature_2m": F.lit(None).cast("double"),
        "relative_humidity_2m": F.lit(None).cast("double")})
