"""Market rows from files, and cleaned series."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions import clean
from wattframe.joins import on_keys
from wattframe.operators import panel, quality, relational as rel, splits
from wattframe.sources.tables import file_attributes

DATE_FORMATS = ("yyyy-MM-dd", "dd.MM.yyyy")  # fixed values: the two encodings seen in the files


def build_market_hourly(raw: DataFrame, directions: Mapping[str, str], money: Sequence[str], formats: Sequence[str] = DATE_FORMATS) -> dict[str, DataFrame]:
    """Raw file rows (file_name, date_txt, hour_txt, direction, money texts) to hourly rows and monthly totals."""
    # names are read once per file, not once per row
    files = raw.select("file_name").distinct().select("file_name", *file_attributes(F.col("file_name")))
    d = clean.vote_date_format(raw, "date_txt", list(formats), ["file_name"], "date")
    d = on_keys(d, files, ["file_name"])
    hourly = d.select(
        "date", clean.parse_hour("hour_txt").alias("hour"),
        clean.map_alias(F.lower(F.trim("direction")), directions, F.col("direction")).alias("direction"),
        *[clean.to_double(c).alias(c) for c in money], "year", "month", "zone")
    hourly = hourly.filter(F.col("date").isNotNull() & F.col("hour").isNotNull())
    monthly = hourly.groupBy("year", "month", "zone").agg(
        F.count("*").alias("rows"), *[rel.zero_sum(c).alias(f"total_{c}") for c in money])
    return {"hourly": hourly, "monthly": monthly}


def clean_series(raw: DataFrame, keys: Sequence[str], time_txt: str, values: Sequence[str], order: str, unit: str = "hour") -> dict[str, DataFrame]:
    """Repair times, drop blank rows and rows without a time, keep the first row per time, and report the rest."""
    d = raw.withColumn("ts", clean.repair_compact_timestamp(time_txt))
    kept = rel.drop_blank_rows(d.select(*keys, "ts", order, *values), [*keys, "ts", order]).filter(F.col("ts").isNotNull())
    rows = splits.keep_first(kept, [*keys, "ts"], [order]).drop(order)
    return {"rows": rows, "missing": panel.missing_steps(rows, keys, "ts", unit, per_series=True),
            "report": quality.cleaning_report(d, keys, time_txt, "ts", values)}


def refresh_by_year(table: DataFrame, newer: DataFrame, year: str, flags: Sequence[str], last: int, since: int, keys: Sequence[str] = ()) -> dict[str, DataFrame]:
    """A yearly table with the rows of a newer source in place of its own, missing-value flags, and a report.

    Only columns that ``table`` knows come from ``newer``, from ``since`` on; of two rows of a year (and ``keys``) the newer source's stays.
    Rows up to ``last`` are kept; those without a year go. ``report`` has a row for each flag: how many years lack the value.
    """
    at = F.col(year).try_cast("int")
    shared = [c for c in table.columns if c in newer.columns]
    parts = splits.union_all(table.withColumn("_rank", F.lit(0)), newer.filter(at >= since).select(*shared).withColumn("_rank", F.lit(1)))
    dated = parts.withColumn(year, at).filter(F.col(year) <= last)
    rows = clean.missing_flags(splits.keep_last(dated, [*keys, year], ["_rank"]).drop("_rank"), flags)
    counts = F.array(*[F.struct(F.lit(c).alias("column"), F.sum(f"{c}_missing_flag").alias("n_missing")) for c in flags])
    return {"rows": rows, "report": rows.agg(counts.alias("_c")).select(F.inline("_c"))}


def clean_generation(df: DataFrame, value: str, category: str, allowed: Sequence[str] = ("net imports",)) -> dict[str, DataFrame]:
    """A generation table whose values are numbers, with negative ones nulled outside ``allowed``, and the counts of both kinds."""
    numbers = df.withColumn(value, clean.to_double(F.col(value).cast("string")))
    rows = clean.sign_rule(numbers, value, category, allowed)
    negative = numbers.select((F.col(value) < 0).alias("_n"), F.lower(F.trim(category)).isin(*allowed).alias("_a"))
    return {"rows": rows, "report": negative.agg(F.count_if("_n").alias("n_negative"), F.count_if(F.col("_n") & F.col("_a")).alias("n_allowed"),
                                                 F.count_if(F.col("_n") & ~F.coalesce("_a", F.lit(False))).alias("n_nulled"))}
