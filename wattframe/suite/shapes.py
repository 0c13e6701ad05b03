"""Reshape queries."""

from pyspark.sql import functions as F

from wattframe.operators import panel, reshape
from wattframe.suite.registry import query, rounded


@query("r1_melt", """
select ts, split_part(name, '_', 1) as region_id, round(v, 4) as load_mw from (
  unpivot fx_load_wide on click_load_actual, error_load_actual, purchase_load_actual, signup_load_actual, view_load_actual into name name value v) u""")
def melt(v):
    cols = [c for c in v.load_wide.columns if c != "ts"]
    long = reshape.melt(v.load_wide, ["ts"], cols, "name", "load_mw").filter(F.col("load_mw").isNotNull())
    return rounded(long.select("ts", F.split_part("name", F.lit("_"), F.lit(1)).alias("region_id"), "load_mw"), 4)


@query("r2_pivot", """
select yr::int as yr, section, """ + ", ".join(
    f"round(sum(case when fuel_group = '{g}' then value end), 2) as \"{g}\"" for g in
    ("ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD")) + """
from fx_balance_long where unit = 'TJ' group by 1, 2""")
def pivot(v):
    tj = v.balance_long.filter("unit = 'TJ'")
    return rounded(reshape.pivot(tj, ["yr", "section"], "fuel_group", F.sum("value")), 2)


@query("r2_pivot_two_levels", """
select line_item, """ + ", ".join(
    f"round(sum(case when yr = {y} and section = '{s}' then value end), 2) as \"{y}__{s}\""
    for y in range(1992, 1999) for s in ("F", "O")) + """
from fx_balance_long where unit = 'TJ' group by 1""")
def pivot_two_levels(v):
    tj = v.balance_long.filter("unit = 'TJ'")
    names = [f"{y}__{s}" for y in range(1992, 1999) for s in ("F", "O")]
    return rounded(reshape.pivot(tj, ["line_item"], ["yr", "section"], F.sum("value"), names), 2)


@query("r3_pivot_first", """
select yr::int as yr, round(arg_min(case when metric = 'F' then value_bkwh end, case when metric = 'F' then source_year_report end), 4) as "F",
  round(arg_min(case when metric = 'O' then value_bkwh end, case when metric = 'O' then source_year_report end), 4) as "O"
from fx_facts group by 1""")
def pivot_first(v):
    return rounded(reshape.pivot_first(v.facts, ["yr"], "metric", "value_bkwh", "source_year_report", ["F", "O"]), 4)


@query("r4_crosstab", """
select yr::int as yr, count(*) filter (unit = 'TJ') as "TJ", count(*) filter (unit = 'toe') as toe
from fx_balance_long group by 1""")
def crosstab(v):
    return reshape.crosstab(v.balance_long, "yr", "unit", ["TJ", "toe"])


@query("r5_header_forward_fill", """
select sheet::int as sheet, col_idx::int as col_idx, trim(rtrim(cell, ',')) as raw_group,
  last_value(trim(rtrim(cell, ',')) ignore nulls) over (partition by sheet order by col_idx
    rows between unbounded preceding and current row) as fuel_group from fx_cells where row_idx = 3""")
def header_forward_fill(v):
    return (reshape.header_fill(v.cells.filter("row_idx = 3"), ["sheet"])
            .select("sheet", "col_idx", "raw_group", "fuel_group"))


_SECTION_CELL = "case when row_idx = 5 then '1. Supply ' || cell when row_idx = 7 then '3. Final' else cell end"


@query("r6_section_forward_fill", f"""
select sheet::int as sheet, row_idx::int as row_idx, label, last_value(sec ignore nulls) over (partition by sheet order by row_idx
  rows between unbounded preceding and current row) as section from (
  select sheet, row_idx, label, case when starts_with(label, '1.') then '1_total_supply'
    when starts_with(label, '3.') then '3_final_consumption' end as sec from (
    select sheet, row_idx, {_SECTION_CELL} as label from fx_cells where col_idx = 0) a) b""")
def section_forward_fill(v):
    labels = v.cells.filter("col_idx = 0").select("sheet", "row_idx", F.expr(_SECTION_CELL).alias("label"))
    return reshape.section_fill(labels, ["sheet"]).select("sheet", "row_idx", "label", "section")


GRID_SQL = """
with h as (select sheet, col_idx, max(case when row_idx = 3 then trim(rtrim(cell, ',')) end) as raw,
    max(case when row_idx = 4 then trim(regexp_replace(cell, ',?\\s*GWh\\s*$', '', 'i')) end) as fuel
  from fx_cells where row_idx in (3, 4) and col_idx > 0 group by 1, 2),
g as (select *, last_value(raw ignore nulls) over (partition by sheet order by col_idx
    rows between unbounded preceding and current row) as grp from h),
l as (select sheet, row_idx, trim(cell) as label from fx_cells where col_idx = 0 and row_idx >= 5)
select b.sheet::int as sheet, b.row_idx::int as row_idx, b.col_idx::int as col_idx, cast(null as varchar) as section,
  l.label as line_item, g.grp as fuel_group, coalesce(nullif(g.fuel, ''), g.raw) as fuel, cast(b.cell as double) as value
from fx_cells b join l on l.sheet = b.sheet and l.row_idx = b.row_idx join g on g.sheet = b.sheet and g.col_idx = b.col_idx
where b.row_idx >= 5 and b.col_idx > 0 and b.cell <> '-'"""


@query("r7_grid_to_long", GRID_SQL)
def grid_to_long(v):
    return reshape.grid_to_long(v.cells, ["sheet"])


@query("r8_models_wide", """
select region_id, ts, round(max(y_true), 6) as y_true, """ + ", ".join(
    f"round(max(case when model = '{m}' then y_pred end), 6) as pred_{m}" for m in ("mean24", "persistence", "seasonal")) + """
from fx_preds group by 1, 2""")
def models_wide(v):
    models = ["mean24", "persistence", "seasonal"]
    wide = reshape.pivot(v.preds, ["region_id", "ts", "y_true"], "model", F.max("y_pred"), models)
    return rounded(wide.select("region_id", "ts", "y_true", *[F.col(m).alias(f"pred_{m}") for m in models]), 6)


@query("r9_sequence_windows", """
select region_id, ts, round(y, 4) as y, array_to_string(list_transform(w, lambda x: printf('%.3f', round(x, 3))), ' ') as seq from (
  select region_id, ts, y, list(y) over (partition by region_id order by ts rows between 24 preceding and 1 preceding) as w
  from fx_hourly_dense) a where len(w) = 24""")
def sequence_windows(v):
    p = panel.with_hour_position(v.dense, "ts")
    w = panel.sequence_windows(p, ["region_id"], "pos", "y", 24, dense=True)
    text = F.array_join(F.transform("window", lambda x: F.format_string("%.3f", F.round(x, 3))), " ")
    return rounded(w.select("region_id", "ts", "y", text.alias("seq")), 4)
