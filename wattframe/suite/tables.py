"""Source, sink and catalog queries."""

import uuid

from pyspark.sql import functions as F

from wattframe.session import checkpoint_folder
from wattframe.sources import tables as io
from wattframe.suite.registry import query, rounded


def _scratch(v, name):
    """A fresh folder below the shared checkpoint folder."""
    return f"{checkpoint_folder(v.spark)}/wattframe-{name}-{uuid.uuid4().hex}"


@query("s1_read_table", """
select yr::int as yr, metric, round(value_bkwh, 4) as value_bkwh, source_year_report::int as source_year_report
from fx_facts""")
def read_table(v):
    rows = io.read_table(v.spark, f"{v.sf_dir}/lineitem.parquet", required=["l_shipdate", "l_quantity", "l_linestatus"])
    yr = F.year("l_shipdate")
    facts = rows.groupBy(yr.alias("yr"), F.col("l_linestatus").alias("metric"), (2000 + yr % 5).alias("source_year_report")).agg(
        (F.sum("l_quantity") / 1000).alias("value_bkwh"))
    return rounded(io.require_columns(facts, ["yr", "metric", "value_bkwh", "source_year_report"]), 4)


@query("s2_projected_scan", "select o_orderkey, o_orderdate as ts, o_totalprice from orders")
def projected_scan(v):
    df = io.read_table(v.spark, f"{v.sf_dir}/orders.parquet", columns=["o_orderkey", "o_orderdate", "o_totalprice"],
                       timestamps=["o_orderdate"])
    return df.withColumnRenamed("o_orderdate", "ts")


@query("s3_scan_folder", """
select 'events.parquet' as file_name, event_type, count(*) as n, round(sum(value), 2) as total from events group by 2""")
def scan_folder(v):
    df = io.scan_folder(v.spark, v.sf_dir, "event*.parquet", required=["event_type", "value"])
    return rounded(df.groupBy("file_name", "event_type").agg(F.count("*").alias("n"), F.sum("value").alias("total")), 2)


@query("s4_file_attributes", """
select (2018 + o_orderkey % 7)::int as year, (case when o_orderkey % 2 = 0 then 5 else 10 end)::int as month,
  case o_orderkey % 3 when 0 then 'West' when 1 then 'North-South' end as zone, count(*) as n
from orders group by 1, 2, 3""")
def file_attributes(v):
    k = F.col("o_orderkey")
    name = F.concat(F.lit("Баланс "), F.when(k % 2 == 0, "Май").otherwise("октябрь"), F.lit(" "),
                    (2018 + k % 7).cast("string"), F.lit(" "),
                    F.when(k % 3 == 0, "Запад").when(k % 3 == 1, "Север-Юг").otherwise("все"), F.lit(".xlsx"))
    return (v.t("orders").select(*io.file_attributes(name)).groupBy("year", "month", "zone")
            .agg(F.count("*").alias("n")))


@query("s5_available_columns", "select c_custkey, c_acctbal from customer")
def available_columns(v):
    return io.available_columns(v.t("customer"), ["c_custkey", "gdp", "c_acctbal", "population"])


@query("s6_fuzzy_column", """
select o_orderdate as ts, o_totalprice as payment, cast(null as varchar) as zone from orders""")
def fuzzy_column(v):
    out = io.rename_fuzzy(v.t("orders"), {"ts": ["дата", "date"], "payment": ["price", "поставщик"], "zone": ["region"]})
    return out.withColumn("zone", F.col("zone").cast("string"))


@query("s7_json_arrays_to_rows", """
select event_id, unnest([cast(json_extract(props, '$.k') as bigint), event_id % 24]) as hour,
  unnest([value, value * 2]) as temp from events""")
def json_arrays_to_rows(v):
    k = F.get_json_object("props", "$.k")
    payload = F.concat(F.lit('{"hourly":{"hour":['), k, F.lit(","), (F.col("event_id") % 24).cast("string"),
                       F.lit('],"temp":['), F.col("value").cast("string"), F.lit(","),
                       (F.col("value") * 2).cast("string"), F.lit("]}}"))
    df = v.t("events").select("event_id", payload.alias("payload"))
    return io.json_arrays_to_rows(df, "payload", {"hour": "bigint", "temp": "double"}, path="hourly")


@query("s8_write_table", "select zone, direction, count(*) as n, round(sum(payment), 2) as total from fx_market group by 1, 2")
def write_table(v):
    path = _scratch(v, "market")
    io.write_table(v.market.withColumn("day", F.day("d")), path, partition_by=["zone"])
    back = v.spark.read.parquet(path)
    return rounded(back.groupBy("zone", "direction").agg(F.count("*").alias("n"), F.sum("payment").alias("total")), 2)


@query("s9_replace_slice", """
select region_id as target, count(*) as n, round(sum(case when region_id = 'view' then y * 2 else y end), 2) as total
from fx_hourly group by 1""")
def replace_slice(v):
    path = _scratch(v, "scores")
    rows = v.hourly.select(F.col("region_id").alias("target"), "ts", "y")
    io.write_table(rows, path, partition_by=["target"])
    io.replace_slice(rows.filter("target = 'view'").withColumn("y", F.col("y") * 2), path, ["target"])
    back = v.spark.read.parquet(path)
    return rounded(back.groupBy(F.col("target").cast("string").alias("target"))
                   .agg(F.count("*").alias("n"), F.sum("y").alias("total")), 2)


@query("s10_write_csv", "select yr::int as yr, mo::int as mo, zone, n, round(total, 2) as total from fx_monthly_zone")
def write_csv(v):
    path = _scratch(v, "csv")
    io.write_table(v.monthly_zone, path, fmt="csv")
    return rounded(io.read_table(v.spark, path, "csv", schema="yr int, mo int, zone string, n bigint, total double"), 2)


@query("s11_build_metadata", """
with d as (select yr, unit from fx_balance_long)
select 'n_rows' as key, cast(count(*) as varchar) as value from d
union all select 'years', string_agg(y, ',' order by y) from (select distinct cast(yr as varchar) as y from d) a
union all select 'units', string_agg(unit, ',' order by unit) from (select distinct unit from d) b""")
def build_metadata(v):
    return io.build_metadata(v.balance_long, {"years": "yr", "units": "unit"}, built_at=False)


@query("s12_build_manifest", """
select 'load' as tbl, region_id as grp, count(*) as n_rows, min(ts) as first_ts, max(ts) as last_ts from fx_hourly group by 2
union all select 'orders', o_orderstatus, count(*), min(o_orderdate), max(o_orderdate) from orders group by 2""")
def build_manifest(v):
    return io.build_manifest({"load": (v.hourly, "region_id", "ts"), "orders": (v.t("orders"), "o_orderstatus", "o_orderdate")})


# The columns of the standard tables, with the names of their types in a profile.
PROFILED = {
    "region": ["r_regionkey", "r_name"],
    "supplier": ["s_suppkey", "s_name", "s_nationkey", "s_acctbal"],
    "part": ["p_partkey", "p_name", "p_brand", "p_type", "p_size", "p_retailprice"],
    "embeddings": ["vec_id", "embedding", "label"],
    "pages": ["page_id", "url", "html"],
    "benchmark": ["item_id", "text"],
    "labels": ["doc_id", "quality", "toxic"],
    "conversations": ["conv_id", "turn", "role", "text"],
    "nation": ["n_nationkey", "n_name", "n_regionkey"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "events": ["event_id", "ts", "user_id", "event_type", "value", "props"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount",
                 "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
}


# a column's type from any of its values, by the names that Spark gives types
TYPE_NAME = """(select case any_value(typeof({c})) when 'INTEGER' then 'int' when 'VARCHAR' then 'string' when 'FLOAT[]' then 'array<float>'
  when 'TIMESTAMP WITH TIME ZONE' then 'timestamp' when 'TIMESTAMP' then '{stamp}' else lower(any_value(typeof({c}))) end)""".replace("{stamp}", "timestamp_ntz")


@query("s13_catalog_profile", " union all ".join(
    f"select '{t}' as tbl, '{c}' as column_name, {TYPE_NAME.format(c=c)} as column_type, count(*) as n_rows, {len(cols)} as n_columns, "
    f"count(*) - count({c}) as n_null from {t}" for t, cols in PROFILED.items() for c in cols)
    + " union all select 'all tables', null, null, " + " + ".join(f"(select count(*) from {t})" for t in PROFILED)
    + f", {sum(map(len, PROFILED.values()))}, " + " + ".join(f"(select count(*) - count({c}) from {t})" for t, cols in PROFILED.items() for c in cols))
def catalog_profile(v):
    return io.catalog_profile({t: v.t(t) for t in PROFILED}, total="all tables")


@query("s14_preview", "select event_id, ts, value from events order by event_id limit 10")
def preview(v):
    return io.preview(v.t("events").select("event_id", "ts", "value"), ["event_id"], 10)


@query("s15_pick_sheet", """
with c as (select sheet % 2 as file_id, case when sheet % 3 = 0 then 'Zone ' else 'Sheet ' end || sheet as sheet_name,
  sheet as pos, row_idx, col_idx, cell from fx_cells),
p as (select file_id, min(pos) filter (contains(lower(sheet_name), 'zone')) as z, min(pos) as m from c group by 1)
select c.file_id::int as file_id, sheet_name, count(*) as n_cells, count(cell) as n_filled from c join p
  on c.file_id = p.file_id and c.pos = coalesce(z, m) group by 1, 2""")
def pick_sheet(v):
    s = F.col("sheet")
    c = v.cells.withColumn("file_id", s % 2).withColumn("pos", s).withColumn(
        "sheet_name", F.concat(F.when(s % 3 == 0, "Zone ").otherwise("Sheet "), s.cast("string")))
    picked = io.pick_sheet(c, "file_id", "sheet_name", "pos", ["zone"])
    return picked.groupBy("file_id", "sheet_name").agg(F.count("*").alias("n_cells"), F.count("cell").alias("n_filled"))
