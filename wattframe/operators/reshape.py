"""Wide and long forms, and spreadsheet cell grids."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wattframe.joins import on_keys
from wattframe.functions import clean

GROUP_ROW, FUEL_ROW, FIRST_DATA_ROW = 3, 4, 5  # fixed values: layout of a balance sheet


def melt(df: DataFrame, ids: Sequence[str], values: Sequence[str], var: str = "variable", value: str = "value") -> DataFrame:
    return df.select(*ids, *values).unpivot(list(ids), list(values), var, value)


def pivot(df: DataFrame, index: Sequence[str], column: str | Sequence[str], agg: Column,
          values: Sequence | None = None, sep: str = "__") -> DataFrame:
    """Long to wide. Pass ``values`` when known: it saves the pass that finds them."""
    if not isinstance(column, str):
        df, column = df.withColumn("_col", F.concat_ws(sep, *column)), "_col"
    return df.groupBy(*index).pivot(column, list(values) if values is not None else None).agg(agg)


def pivot_first(df: DataFrame, index: Sequence[str], column: str, value: str, order: str,
                values: Sequence | None = None) -> DataFrame:
    """One value per cell: the one with the smallest order key."""
    return pivot(df, index, column, F.min_by(value, order), values)


def crosstab(df: DataFrame, row: str, column: str, values: Sequence | None = None) -> DataFrame:
    return df.groupBy(row).pivot(column, list(values) if values is not None else None).count().na.fill(0)


def header_fill(cells: DataFrame, sheet: Sequence[str], col: str = "col_idx", label: str = "cell") -> DataFrame:
    """Carry a group label over the columns until the next one. A sheet's width is bounded by its format."""
    w = W.partitionBy(*sheet).orderBy(col).rowsBetween(W.unboundedPreceding, 0)
    raw = F.when(clean.strip(label) != "", clean.normalize_fuel_group(label))
    return (cells.withColumn("raw_group", raw)
            .withColumn("fuel_group", F.last("raw_group", ignorenulls=True).over(w)))


def section_fill(rows: DataFrame, sheet: Sequence[str], row: str = "row_idx", label: str = "label") -> DataFrame:
    """Carry the last section heading down the rows of a sheet."""
    w = W.partitionBy(*sheet).orderBy(row).rowsBetween(W.unboundedPreceding, 0)
    return rows.withColumn("section", F.last(clean.classify_section(label), ignorenulls=True).over(w))


def grid_to_long(cells: DataFrame, sheet: Sequence[str]) -> DataFrame:
    """Cell table (sheet.., row_idx, col_idx, cell) to (sheet.., section, line_item, fuel_group, fuel, value)."""
    row, col = F.col("row_idx"), F.col("col_idx")
    heads = (cells.filter(row.isin(GROUP_ROW, FUEL_ROW) & (col > 0)).groupBy(*sheet, "col_idx")
             .agg(F.max(F.when(row == GROUP_ROW, F.col("cell"))).alias("cell"),
                  F.max(F.when(row == FUEL_ROW, F.col("cell"))).alias("fuel_cell")))
    heads = header_fill(heads, sheet)
    fuel = clean.coalesce_label(clean.strip_unit_suffix("fuel_cell"), "raw_group")
    heads = (heads.withColumn("fuel", fuel).filter(F.col("fuel").isNotNull())
             .select(*sheet, "col_idx", "fuel_group", "fuel"))
    labels = (cells.filter((row >= FIRST_DATA_ROW) & (col == 0)).select(*sheet, "row_idx", clean.squeeze("cell").alias("label"))
              .filter(clean.is_data_label("label")))
    labels = (section_fill(labels, sheet)
              .select(*sheet, "row_idx", "section", clean.normalize_line_item("label").alias("line_item")))
    body = (cells.filter((row >= FIRST_DATA_ROW) & (col > 0))
            .select(*sheet, "row_idx", "col_idx", clean.parse_number("cell").alias("value"))
            .filter(F.col("value").isNotNull()))
    return (on_keys(on_keys(body, labels, [*sheet, "row_idx"]), heads, [*sheet, "col_idx"])
            .select(*sheet, "row_idx", "col_idx", "section", "line_item", "fuel_group", "fuel", "value"))
