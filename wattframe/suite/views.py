"""Domain views over the standard tables, once as DataFrames and once as SQL text."""

from __future__ import annotations

import re
from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window as W

from wattframe.operators import panel
from wattframe.session import cut_lineage

# Places spread over the grid of the weather view, for the resource queries: label, latitude, longitude, resource.
LOCATIONS = [
    ("north", 50.2, 60.7, "wind"),
    ("east", 46.4, 75.1, "solar"),
    ("west", 42.8, 51.6, "wind"),
    ("south", 40.9, 66.3, "solar"),
]


def _num(text: str):
    return F.expr(text).cast("double")


class Views:
    """The standard tables under one folder, plus the views derived from them."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark = spark
        self.sf_dir = sf_dir

    def t(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    def literal(self, rows: list[tuple], schema: str) -> DataFrame:
        """A small fixed table as a local relation inside the plan."""
        fields = T._parse_datatype_string(schema).fields
        struct = F.array(*[
            F.struct(*[F.lit(v).cast(f.dataType).alias(f.name) for v, f in zip(row, fields)]) for row in rows])
        return self.spark.range(1).select(F.inline(struct))

    @cached_property
    def hourly(self) -> DataFrame:
        return (self.t("events")
                .groupBy(F.col("event_type").alias("region_id"),
                         F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
                .agg(F.sum("value").alias("y"), F.count("*").alias("n")))

    @cached_property
    def dense(self) -> DataFrame:
        h = self.hourly.select("region_id", "ts", "y")
        out = panel.dense_panel(h, ["region_id"], "ts", "hour")
        return out.select("region_id", "ts", F.coalesce("y", F.lit(0.0)).alias("y"),
                          F.col("y").isNull().cast("int").alias("is_filled"))

    @cached_property
    def market(self) -> DataFrame:
        u = F.col("user_id") % 3
        return self.t("events").select(
            F.col("ts").cast("date").alias("d"), F.hour("ts").alias("hr"), F.col("event_type").alias("zone"),
            F.when(u == 0, "up").when(u == 1, "down").otherwise("none").alias("direction"),
            F.col("value").alias("payment"))

    @cached_property
    def daily(self) -> DataFrame:
        d = (self.t("orders").groupBy(F.col("o_orderdate").cast("date").alias("d"))
             .agg(F.sum("o_totalprice").alias("v")))
        top = d.agg(F.max("v").alias("m"))
        return d.select("d", "v", (F.col("v") / top.scalar()).alias("cf"))

    @cached_property
    def monthly_zone(self) -> DataFrame:
        zones = (self.t("customer").join(self.t("nation"), F.col("c_nationkey") == F.col("n_nationkey"))
                 .join(self.t("region"), F.col("n_regionkey") == F.col("r_regionkey"))
                 .select("c_custkey", F.col("r_name").alias("zone")))
        return (self.t("orders").join(zones, F.col("o_custkey") == F.col("c_custkey"))
                .groupBy(F.year("o_orderdate").alias("yr"), F.month("o_orderdate").alias("mo"), "zone")
                .agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")))

    @cached_property
    def _line_part(self) -> DataFrame:
        return self.t("lineitem").join(self.t("part"), F.col("l_partkey") == F.col("p_partkey"))

    @cached_property
    def balance_long(self) -> DataFrame:
        units = F.array(F.struct(F.lit("TJ").alias("unit"), F.lit(1.0).alias("k")),
                        F.struct(F.lit("toe").alias("unit"), F.lit(1.0 / 41.868).alias("k")))
        base = (self._line_part
                .groupBy(F.year("l_shipdate").alias("yr"), F.col("l_linestatus").alias("section"),
                         F.col("l_returnflag").alias("line_item"), F.col("p_type").alias("fuel_group"),
                         F.col("p_brand").alias("fuel"))
                .agg(F.sum("l_extendedprice").alias("v")))
        return (base.select("*", F.inline(units))
                .select("yr", "unit", "section", "line_item", "fuel_group", "fuel",
                        (F.col("v") * F.col("k")).alias("value")))

    @cached_property
    def prod_cons(self) -> DataFrame:
        p = (self.t("lineitem").groupBy(F.year("l_shipdate").alias("yr"))
             .agg(F.sum("l_extendedprice").alias("production")))
        c = (self.t("orders").groupBy(F.year("o_orderdate").alias("yr"))
             .agg(F.sum("o_totalprice").alias("consumption")))
        return p.join(c, "yr")

    @cached_property
    def fuel_emis(self) -> DataFrame:
        return (self._line_part.groupBy(F.col("p_type").alias("fuel"), F.year("l_shipdate").alias("yr"))
                .agg(F.sum("l_quantity").alias("g"),
                     F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("c")))

    @cached_property
    def facts(self) -> DataFrame:
        yr = F.year("l_shipdate")
        return (self.t("lineitem")
                .groupBy(yr.alias("yr"), F.col("l_linestatus").alias("metric"),
                         (2000 + yr % 5).alias("source_year_report"))
                .agg((F.sum("l_quantity") / 1000).alias("value_bkwh"))
                .select("yr", "metric", "value_bkwh", "source_year_report"))

    @cached_property
    def tokens(self) -> DataFrame:
        s, i, k = F.col("s_suppkey"), F.col("i"), self.t("supplier")
        five = k.select("s_suppkey", F.explode(F.sequence(F.lit(1), F.lit(5))).alias("i"))
        years = five.select(s.alias("page"), F.lit(100.0).alias("y0"), (40.0 * i).alias("x0"),
                            (2015 + i).cast("string").alias("txt"))
        nums = five.select(s.alias("page"), (70.0 + s % 10).alias("y0"), (40.0 * i + s % 20).alias("x0"),
                           (60 + (s * 7 + i * 11) % 80).cast("string").alias("txt"))
        words = k.select(s.alias("page"), F.lit(20.0).alias("y0"), F.lit(10.0).alias("x0"),
                         F.lit("billion kWh").alias("txt"))
        return years.unionByName(nums).unionByName(words)

    @cached_property
    def weather(self) -> DataFrame:
        u, v = F.col("user_id"), F.col("value")
        return self.t("events").select(
            "ts", (u % 4).alias("loc"), ((u % 15) - 7.0).alias("u100"), ((u % 11) - 5.0).alias("v100"),
            (250.0 + v % 60).alias("t2m_k"), (250.0 + v % 60 - u % 20).alias("d2m_k"),
            ((v % 24) * 150000.0).alias("ssrd"))

    @cached_property
    def grid(self) -> DataFrame:
        s = F.col("s_suppkey")
        return self.t("supplier").select((40.0 + s % 12).alias("lat"), (50.0 + s % 27).alias("lon")).distinct()

    @cached_property
    def sites(self) -> DataFrame:
        return (self.t("nation").join(self.t("customer"), F.col("n_nationkey") == F.col("c_nationkey"))
                .join(self.t("orders"), F.col("c_custkey") == F.col("o_custkey"))
                .groupBy(F.col("n_name").alias("site"), F.col("n_regionkey").alias("region"))
                .agg(F.count_distinct("c_custkey").alias("demand"), F.avg("c_acctbal").alias("credit"),
                     F.sum("o_totalprice").alias("volume"), F.min("o_totalprice").alias("cost"))
                .select("site", "demand", "credit", "volume", "cost", "region"))

    @cached_property
    def dirty(self) -> DataFrame:
        k, z = F.col("p_partkey"), F.col("p_size")
        day = (10 + z % 18).cast("string")
        month = (1 + z % 9).cast("string")
        return self.t("part").select(
            k.alias("id"), (k % 8).alias("file_id"),
            F.when(k % 6 == 0, "-").when(k % 6 == 1, "1 234,5").when(k % 6 == 2, "12,5")
            .when(k % 6 == 3, z.cast("string")).when(k % 6 == 4, "n/a").otherwise("1,234.50").alias("num_txt"),
            F.concat(F.lit("  "), F.upper("p_type"), F.lit(",   2 MILLION cubik meters")).alias("label_txt"),
            F.concat_ws("-", (z % 24).cast("string"), ((z + 1) % 24).cast("string")).alias("hour_txt"),
            F.when(k % 8 < 4, F.concat(F.lit("2024-0"), month, F.lit("-"), day))
            .otherwise(F.concat(day, F.lit(".0"), month, F.lit(".2024"))).alias("date_txt"))

    @cached_property
    def load_wide(self) -> DataFrame:
        kinds = ["click", "error", "purchase", "signup", "view"]
        return (self.t("events").groupBy(F.date_trunc("hour", "ts").cast("timestamp_ntz").alias("ts"))
                .agg(*[F.sum(F.when(F.col("event_type") == k, F.col("value"))).alias(f"{k}_load_actual")
                       for k in kinds]))

    @cached_property
    def cells(self) -> DataFrame:
        # a sheet's width is the number of brands, its height the number of labels: both far below sheet limits
        heads = (self.t("part").select(F.col("p_type").alias("g"), F.col("p_brand").alias("b")).distinct()
                 .withColumn("col_idx", F.row_number().over(W.orderBy("g", "b")))
                 .withColumn("k", F.row_number().over(W.partitionBy("g").orderBy("b"))))
        vals = (self._line_part
                .groupBy(F.year("l_shipdate").alias("sheet"), F.col("l_returnflag").alias("lab"),
                         F.col("p_type").alias("g"), F.col("p_brand").alias("b"))
                .agg(F.sum("l_extendedprice").alias("val")))
        vals = cut_lineage(vals)  # a stored sheet: its parts below must not recompute it
        labels = (vals.select("sheet", "lab").distinct()
                  .withColumn("row_idx", 4 + F.dense_rank().over(W.partitionBy("sheet").orderBy("lab"))))
        sheet_list = vals.agg(F.collect_set("sheet"))
        per_sheet = heads.withColumn("sheet", F.explode(sheet_list.scalar()))
        cols = ("sheet", "row_idx", "col_idx", "cell")
        groups = per_sheet.select("sheet", F.lit(3).alias("row_idx"), "col_idx",
                                  F.when(F.col("k") == 1, F.concat("g", F.lit(","))).alias("cell"))
        fuels = per_sheet.select("sheet", F.lit(4).alias("row_idx"), "col_idx",
                                 F.concat("b", F.lit(", GWh")).alias("cell"))
        stubs = labels.select("sheet", "row_idx", F.lit(0).alias("col_idx"),
                              F.concat("lab", F.lit(" (+)")).alias("cell"))
        body = (vals.join(labels, ["sheet", "lab"]).join(heads, ["g", "b"])
                .select("sheet", "row_idx", "col_idx",
                        F.when(F.col("col_idx") % 17 == 0, "-")
                        .otherwise(F.round("val").cast("bigint").cast("string")).alias("cell")))
        # the stored cell table that the balance jobs start from
        return cut_lineage(groups.select(*cols).unionByName(fuels).unionByName(stubs).unionByName(body))

    @cached_property
    def preds(self) -> DataFrame:
        def lagged(w):
            return [F.lag("y", 1).over(w).alias("p1"), F.lag("y", 24).over(w).alias("p24"),
                    F.avg("y").over(w.rowsBetween(-24, -1)).alias("p_mean")]

        w = panel.over_chunks(panel.with_hour_position(self.dense, "ts"), ["region_id"], "pos", lagged, back=24, dense=True)
        models = F.array(*[F.struct(F.lit(m).alias("model"), F.col(c).alias("y_pred"))
                           for m, c in (("persistence", "p1"), ("seasonal", "p24"), ("mean24", "p_mean"))])
        return (w.filter(F.col("p24").isNotNull())
                .select("region_id", "ts", F.col("y").alias("y_true"), F.inline(models))
                .select("region_id", "ts", "model", "y_true", "y_pred"))


VIEW_SQL: dict[str, str] = {
    "fx_hourly": """select event_type as region_id, date_trunc('hour', ts) as ts, sum(value) as y, count(*) as n
        from events group by 1, 2""",
    "fx_market": """select cast(ts as date) as d, hour(ts) as hr, event_type as zone,
        case when user_id % 3 = 0 then 'up' when user_id % 3 = 1 then 'down' else 'none' end as direction,
        value as payment from events""",
    "fx_daily": """select d, v, v / max(v) over () as cf from (
        select cast(o_orderdate as date) as d, sum(o_totalprice) as v from orders group by 1) t""",
    "fx_monthly_zone": """select year(o_orderdate) as yr, month(o_orderdate) as mo, r_name as zone, count(*) as n,
        sum(o_totalprice) as total from orders join customer on o_custkey = c_custkey
        join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey group by 1, 2, 3""",
    "fx_balance_long": """select year(l_shipdate) as yr, u.unit, l_linestatus as section, l_returnflag as line_item,
        p_type as fuel_group, p_brand as fuel, sum(l_extendedprice * u.k) as value
        from lineitem join part on l_partkey = p_partkey
        cross join (values ('TJ', cast(1.0 as double)), ('toe', cast(1.0 as double) / 41.868)) u(unit, k)
        group by 1, 2, 3, 4, 5, 6""",
    "fx_prod_cons": """select p.yr, p.production, c.consumption
        from (select year(l_shipdate) as yr, sum(l_extendedprice) as production from lineitem group by 1) p
        join (select year(o_orderdate) as yr, sum(o_totalprice) as consumption from orders group by 1) c
        on p.yr = c.yr""",
    "fx_fuel_emis": """select p_type as fuel, year(l_shipdate) as yr, sum(l_quantity) as g,
        sum(l_extendedprice * (1 - l_discount)) as c from lineitem join part on l_partkey = p_partkey
        group by 1, 2""",
    "fx_facts": """select year(l_shipdate) as yr, l_linestatus as metric, sum(l_quantity) / 1000 as value_bkwh,
        2000 + year(l_shipdate) % 5 as source_year_report from lineitem group by 1, 2, 4""",
    "fx_tokens": """select s_suppkey as page, 100.0::double as y0, (40.0 * i)::double as x0,
        cast(2015 + i as varchar) as txt from supplier cross join (values (1), (2), (3), (4), (5)) t(i)
        union all select s_suppkey, (70.0 + s_suppkey % 10)::double, (40.0 * i + s_suppkey % 20)::double,
        cast(60 + (s_suppkey * 7 + i * 11) % 80 as varchar)
        from supplier cross join (values (1), (2), (3), (4), (5)) t(i)
        union all select s_suppkey, 20.0::double, 10.0::double, 'billion kWh' from supplier""",
    "fx_weather": """select ts, user_id % 4 as loc, ((user_id % 15) - 7.0)::double as u100,
        ((user_id % 11) - 5.0)::double as v100, 250.0 + value % 60 as t2m_k,
        250.0 + value % 60 - user_id % 20 as d2m_k, (value % 24) * 150000.0 as ssrd from events""",
    "fx_grid": """select distinct (40.0 + s_suppkey % 12)::double as lat, (50.0 + s_suppkey % 27)::double as lon
        from supplier""",
    "fx_locations": """select label, lat::double as lat, lon::double as lon, resource from (values
        ('north', 50.2, 60.7, 'wind'), ('east', 46.4, 75.1, 'solar'), ('west', 42.8, 51.6, 'wind'),
        ('south', 40.9, 66.3, 'solar')) t(label, lat, lon, resource)""",
    "fx_sites": """select n_name as site, count(distinct c_custkey) as demand, avg(c_acctbal) as credit,
        sum(o_totalprice) as volume, min(o_totalprice) as cost, n_regionkey as region
        from nation join customer on c_nationkey = n_nationkey join orders on o_custkey = c_custkey
        group by n_name, n_regionkey""",
    "fx_dirty": """select p_partkey as id, p_partkey % 8 as file_id,
        case p_partkey % 6 when 0 then '-' when 1 then '1 234,5' when 2 then '12,5'
        when 3 then cast(p_size as varchar) when 4 then 'n/a' else '1,234.50' end as num_txt,
        concat('  ', upper(p_type), ',   2 MILLION cubik meters') as label_txt,
        concat(cast(p_size % 24 as varchar), '-', cast((p_size + 1) % 24 as varchar)) as hour_txt,
        case when p_partkey % 8 < 4
        then concat('2024-0', cast(1 + p_size % 9 as varchar), '-', cast(10 + p_size % 18 as varchar))
        else concat(cast(10 + p_size % 18 as varchar), '.0', cast(1 + p_size % 9 as varchar), '.2024') end as date_txt
        from part""",
    "fx_hourly_dense": """select r.region_id, g.ts, coalesce(h.y, 0.0) as y,
        case when h.y is null then 1 else 0 end as is_filled
        from (select distinct event_type as region_id from events) r
        cross join (select unnest(generate_series(a, z, interval 1 hour)) as ts from (
          select min(date_trunc('hour', ts)) as a, max(date_trunc('hour', ts)) as z from events) b) g
        left join fx_hourly h on h.region_id = r.region_id and h.ts = g.ts""",
    "fx_load_wide": """select date_trunc('hour', ts) as ts,
        sum(case when event_type = 'click' then value end) as click_load_actual,
        sum(case when event_type = 'error' then value end) as error_load_actual,
        sum(case when event_type = 'purchase' then value end) as purchase_load_actual,
        sum(case when event_type = 'signup' then value end) as signup_load_actual,
        sum(case when event_type = 'view' then value end) as view_load_actual from events group by 1""",
    "fx_cells": """select * from (
        with f as (select p_type as g, p_brand as b, row_number() over (order by p_type, p_brand) as col_idx,
          row_number() over (partition by p_type order by p_brand) as k
          from (select distinct p_type, p_brand from part) t),
        v as (select year(l_shipdate) as sheet, l_returnflag as lab, p_type as g, p_brand as b,
          sum(l_extendedprice) as val from lineitem join part on l_partkey = p_partkey group by 1, 2, 3, 4),
        s as (select distinct sheet from v),
        n as (select sheet, lab, 4 + dense_rank() over (partition by sheet order by lab) as row_idx
          from (select distinct sheet, lab from v) t)
        select s.sheet, 3 as row_idx, f.col_idx, case when f.k = 1 then concat(f.g, ',') end as cell
          from s cross join f
        union all select s.sheet, 4, f.col_idx, concat(f.b, ', GWh') from s cross join f
        union all select n.sheet, n.row_idx, 0, concat(n.lab, ' (+)') from n
        union all select v.sheet, n.row_idx, f.col_idx,
          case when f.col_idx % 17 = 0 then '-' else cast(cast(round(v.val) as bigint) as varchar) end
          from v join n on n.sheet = v.sheet and n.lab = v.lab join f on f.g = v.g and f.b = v.b) cells""",
    "fx_preds": """select * from (
        with w as (select region_id, ts, y as y_true, lag(y, 1) over (partition by region_id order by ts) as p1,
          lag(y, 24) over (partition by region_id order by ts) as p24,
          avg(y) over (partition by region_id order by ts rows between 24 preceding and 1 preceding) as p_mean
          from fx_hourly_dense)
        select region_id, ts, m.model, y_true,
          case m.model when 'persistence' then p1 when 'seasonal' then p24 else p_mean end as y_pred
        from w cross join (values ('persistence'), ('seasonal'), ('mean24')) m(model)
        where p24 is not null) p""",
}


def _needed(sql: str, found: list[str]) -> list[str]:
    for name in re.findall(r"\bfx_\w+", sql):
        if name in VIEW_SQL and name not in found:
            _needed(VIEW_SQL[name], found)
            found.append(name)
    return found


def with_views(sql: str) -> str:
    """Prefix ``sql`` with the definitions of the views it names."""
    body = sql.strip()
    names = _needed(body, [])
    if not names:
        return body
    ctes = ",\n".join(f"{n} as ({VIEW_SQL[n]})" for n in names)
    if body[:15].lower() == "with recursive ":
        return f"with recursive {ctes},\n{body[15:]}"
    if body[:5].lower() == "with ":
        return f"with {ctes},\n{body[5:]}"
    return f"with {ctes}\n{body}"
