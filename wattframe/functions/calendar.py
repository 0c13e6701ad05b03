"""Calendar parts, cyclic encodings and time arithmetic."""

from __future__ import annotations

from collections.abc import Sequence
from math import pi

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _c(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def parts(ts: Column | str) -> dict[str, Column]:
    """Calendar parts of a timestamp; weekdays count from Monday = 0."""
    t = _c(ts)
    return {
        "hour": F.hour(t), "dow": F.weekday(t), "month": F.month(t), "day_of_year": F.dayofyear(t),
        "is_weekend": (F.weekday(t) >= 5).cast("int"),
        "is_month_start": (F.day(t) == 1).cast("int"),
        "is_month_end": (F.to_date(t) == F.last_day(t)).cast("int"),
    }


def with_parts(df: DataFrame, ts: str, wanted: Sequence[str]) -> DataFrame:
    p = parts(ts)
    return df.withColumns({n: p[n] for n in wanted})


def time_dimension(df: DataFrame, ts: str) -> DataFrame:
    """Distinct times of a table."""
    return df.select(ts).distinct()


def calendar_table(df: DataFrame, ts: str, holidays: DataFrame | None = None, holiday_col: str = "d") -> DataFrame:
    """One row per distinct time with calendar parts and the holiday flag (0 without a holiday table)."""
    cal = with_parts(time_dimension(df, ts), ts, ["hour", "dow", "month", "is_weekend", "is_month_start", "is_month_end"])
    return holiday_flag(cal, ts, holidays, holiday_col)


def holiday_flag(df: DataFrame, ts: str, holidays: DataFrame | None, holiday_col: str = "d", name: str = "is_holiday") -> DataFrame:
    if holidays is None:
        return df.withColumn(name, F.lit(0))
    days = holidays.select(F.col(holiday_col).alias("_d")).distinct().withColumn("_h", F.lit(1))
    return (df.join(days, F.to_date(ts) == F.col("_d"), "left")
            .select(*df.columns, F.coalesce("_h", F.lit(0)).alias(name)))


def cyclic(ts: Column | str, hours: float = 24.0, year_days: float = 365.25) -> list[Column]:
    """Sine and cosine of the hour of day and the day of year."""
    p = parts(ts)
    a, b = p["hour"] * (2 * pi / hours), p["day_of_year"] * (2 * pi / year_days)
    return [F.sin(a).alias("hour_sin"), F.cos(a).alias("hour_cos"), F.sin(b).alias("doy_sin"), F.cos(b).alias("doy_cos")]


def fourier(idx: Column | str, period: float, k: int) -> list[Column]:
    """``k`` harmonics of a period: 2k columns."""
    out = []
    for i in range(1, k + 1):
        a = _c(idx) * F.lit(2 * pi * i / period)
        out += [F.sin(a).alias(f"sin_{i}"), F.cos(a).alias(f"cos_{i}")]
    return out


def month_hours(months: DataFrame, year: str, month: str, ts: str = "ts") -> DataFrame:
    """Every hour of each (year, month) row."""
    start = F.make_date(year, month, F.lit(1)).cast("timestamp_ntz")
    end = F.timestamp_add("HOUR", F.lit(23), F.last_day(start).cast("timestamp_ntz")).cast("timestamp_ntz")
    return months.select("*", F.explode(F.sequence(start, end, F.expr("interval 1 hour"))).alias(ts))


def date_plus_hour(date: Column | str, hour: Column | str) -> Column:
    return F.timestamp_add("HOUR", _c(hour), _c(date).cast("timestamp_ntz")).cast("timestamp_ntz")


def to_utc(ts: Column | str, zone: str) -> Column:
    """Local wall time of ``zone`` to a UTC timestamp without zone."""
    return F.convert_timezone(F.lit(zone), F.lit("UTC"), _c(ts).cast("timestamp_ntz"))


def month_start(year: Column | str, month: Column | str) -> Column:
    return F.make_date(_c(year), _c(month), F.lit(1)).cast("timestamp_ntz")
