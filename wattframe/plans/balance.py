"""Energy-balance jobs: spreadsheet cells to balance tables, verified facts, country extracts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.functions import clean
from wattframe.operators import quality, relational as rel, reshape, splits
from wattframe.operators.quantiles import quantiles, with_rank
from wattframe.plans.lazy import LazyTables
from wattframe.sources import tables as io

BALANCE_KEY = ("year", "unit", "section", "line_item", "fuel")
GROUP_LINES = ("Primary energy production", "Imports", "Exports", "Total primary energy consumption",
               "Final energy consumption", "Available for final consumption")  # fixed values


def build_balance(cells: DataFrame, year: str, unit: str, group_lines: Sequence[str] = GROUP_LINES,
                  key: Sequence[str] = BALANCE_KEY, wide_units: Sequence[str] = ("TJ",)) -> Mapping[str, DataFrame]:
    """Cell tables (year, unit, row_idx, col_idx, cell) to the long balance and the tables derived from it.

    ``key`` decides which rows are copies of each other; the first in sheet order stays. Each of ``wide_units`` has a table ``wide_<unit>``.
    """
    grid = cells.withColumnsRenamed({year: "year", unit: "unit"})
    raw = reshape.grid_to_long(grid, ["year", "unit"])
    # NULL sections group together, and the sheet position makes "first" well defined
    long = splits.keep_first(raw.select("year", "unit", "section", "line_item", "fuel_group", "fuel", "value", "row_idx", "col_idx"),
                             key, ["row_idx", "col_idx"]).drop("row_idx", "col_idx")
    electric = long.filter(F.col("fuel_group").rlike("(?i)electricity") | F.contains(F.lower("fuel"), F.lit("electric")))
    lines = F.col("line_item").isin(*group_lines)
    return LazyTables({
        **{f"wide_{u}": lambda u=u: balance_wide(long, u) for u in wide_units},
        "balance_long": lambda: long,
        "electricity": lambda: electric.groupBy("year", "unit", "line_item").agg(F.sum("value").alias("value")),
        "by_fuel_group": lambda: long.filter(lines).groupBy("year", "unit", "fuel_group", "line_item").agg(F.sum("value").alias("value")),
        "metadata": lambda: io.build_metadata(long, {"years": "year", "units": "unit"}),
        "quality": lambda: quality.coverage_report(long, [["year", "unit"], ["section"]], ["line_item", "fuel_group", "fuel"]),
        "distribution": lambda: quantiles(long, ["unit"], "value", {"min": 0.0, "median": 0.5, "max": 1.0}),
    })


def balance_wide(long: DataFrame, unit: str) -> DataFrame:
    """Sink form with one column per year and fuel, and safe column names."""
    one = long.filter(F.col("unit") == unit)
    return clean.with_safe_names(reshape.pivot(one, ["line_item"], ["year", "fuel"], F.sum("value")))


def build_verified_balance(facts: DataFrame, extracted: DataFrame, year: str, metric: str, value: str, order: str,
                           tol: float = 0.5) -> dict[str, DataFrame]:
    """Verified facts as a wide table, and each fact checked against machine-extracted values of its year."""
    wide = reshape.pivot_first(facts, [year], metric, value, order)
    audit = rel.tolerance_flag(facts, extracted, [year], value, tol, "confirmed")
    return {"wide": wide, "audit": audit}


def extract_country(table: DataFrame, country: str, since: int, wanted: Sequence[str], flags: Sequence[str], peers: Sequence[str],
                    peer_year: int, per_capita: tuple[str, str], names: Mapping[str, str] | None = None, recent: int | None = None,
                    searched: tuple[DataFrame, str] | None = None) -> Mapping[str, DataFrame]:
    """One country's modern rows with missing-value flags, and the peer comparison of one year.

    ``recent``: the rows since that year with what the country's table has of ``flags``, as ``recent``. ``searched``: a second table and a text; its rows
    that hold the text in any column come as ``mentions``.
    """
    t = table.withColumnsRenamed(dict(names)) if names else table
    one = io.available_columns(t.filter((F.col("country") == country) & (F.col("year") >= since)), wanted)
    num, den = per_capita
    p = (t.filter(F.col("country").isin(*peers) & (F.col("year") == peer_year))
         .select("country", (F.col(num) / F.when(F.col(den) != 0, F.col(den))).alias("per_capita")))
    found = {"country": lambda: clean.missing_flags(one, flags), "peers": lambda: with_rank(p, [], "per_capita")}
    if recent is not None:
        found["recent"] = lambda: one.filter(F.col("year") >= recent)
    if searched:
        found["mentions"] = lambda: clean.any_column_contains(*searched)
    return LazyTables(found)
