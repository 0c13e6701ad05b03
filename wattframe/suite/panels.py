"""Window and panel-feature queries, all on the gap-free hourly panel unless the gaps are the point."""

from pyspark.ml.feature import StandardScaler, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from wattframe.operators import panel, relational as rel
from wattframe.operators.imputation import impute_median
from wattframe.operators.quantiles import with_rank
from wattframe.suite.relations import CLUSTER_SQL, TAG_SQL
from wattframe.suite.registry import query, rounded

R = ["region_id"]


def dense(v):
    return panel.with_hour_position(v.dense, "ts")


@query("w1_lags", "select region_id, ts, " + ", ".join(
    f"round(lag(y, {k}) over w, 4) as lag_{k}" for k in panel.FEATURE_LAGS)
    + " from fx_hourly_dense window w as (partition by region_id order by ts)")
def lags(v):
    out = panel.over_chunks(dense(v), R, "pos", lambda w: panel.lag_columns(w, "y", panel.FEATURE_LAGS), back=168, dense=True)
    return rounded(out.select("region_id", "ts", *[f"lag_{k}" for k in panel.FEATURE_LAGS]), 4)


@query("w1_lags_row_index", """
select region_id, ts, round(lag(y, 1) over w, 4) as lag_1, round(lag(y, 24) over w, 4) as lag_24
from fx_hourly window w as (partition by region_id order by ts)""")
def lags_row_index(v):
    h = panel.with_row_index(v.hourly, R, ["ts"], F.col("ts").cast("date"), index="pos")
    out = panel.over_chunks(h, R, "pos", lambda w: panel.lag_columns(w, "y", [1, 24]), back=24)
    return rounded(out.select("region_id", "ts", "lag_1", "lag_24"), 4)


@query("w2_lead", """
select region_id, ts, round(lead(y, 24) over (partition by region_id order by ts), 4) as target from fx_hourly_dense""")
def lead(v):
    out = panel.over_chunks(dense(v), R, "pos", lambda w: [F.lead("y", 24).over(w).alias("target")], back=0, ahead=24, dense=True)
    return rounded(out.select("region_id", "ts", "target"), 4)


@query("w3_rolling_mean", """
select region_id, ts, round(avg(y) over (partition by region_id order by ts rows between 23 preceding and current row) + 1e-9, 6) as roll_24,
  round(avg(y) over (partition by region_id order by ts rows between 167 preceding and current row) + 1e-9, 6) as roll_168
from fx_hourly_dense""")
def rolling_mean(v):
    out = panel.over_chunks(dense(v), R, "pos", lambda w: [
        (panel.rolling(w, "y", n) + 1e-9).alias(f"roll_{n}") for n in (24, 168)], back=167, dense=True)  # no ties in rounding
    return rounded(out.select("region_id", "ts", "roll_24", "roll_168"), 6)


@query("w4_rolling_std", """
select region_id, ts, round(stddev_samp(y) over (partition by region_id order by ts rows between 23 preceding and current row), 5)
  as std_24 from fx_hourly_dense""")
def rolling_std(v):
    out = panel.over_chunks(dense(v), R, "pos", lambda w: [panel.rolling(w, "y", 24, "std").alias("std_24")], back=23, dense=True)
    return rounded(out.select("region_id", "ts", "std_24"), 5)


@query("w5_rolling_left", """
select region_id, ts, round(avg(y) over w, 6) as mean_24, round(min(y) over w, 4) as min_24, round(max(y) over w, 4) as max_24
from fx_hourly_dense window w as (partition by region_id order by ts rows between 24 preceding and 1 preceding)""")
def rolling_left(v):
    out = panel.over_chunks(dense(v), R, "pos", lambda w: [
        panel.rolling(w, "y", 24, how, "left").alias(f"{how}_24") for how in ("mean", "min", "max")], back=24, dense=True)
    return rounded(rounded(out.select("region_id", "ts", "mean_24", "min_24", "max_24"), 6, "mean_24"), 4, "min_24", "max_24")


@query("w6_clock_lag", """
select a.region_id, a.ts, round(a.y, 4) as y, round(b.y, 4) as y_24h from fx_hourly a
left join fx_hourly b on a.region_id = b.region_id and b.ts = a.ts - interval 24 hour""")
def clock_lag(v):
    return rounded(panel.clock_lag(v.hourly.drop("n"), R, "ts", "y", 24, "y_24h"), 4)


@query("w7_seasonal_naive", """
select region_id, ts, round(lag(y, 23) over w, 4) as h1, round(lag(y, 0) over w, 4) as h24, round(lag(y, 12) over w, 4) as h36
from fx_hourly_dense window w as (partition by region_id order by ts)""")
def seasonal_naive(v):
    hs = (1, 24, 36)
    out = panel.over_chunks(dense(v), R, "pos", lambda w: [
        F.lag("y", panel.seasonal_shift(h)).over(w).alias(f"h{h}") for h in hs], back=24, dense=True)
    return rounded(out.select("region_id", "ts", *[f"h{h}" for h in hs]), 4)


_Z = """select region_id, ts, y, (y - avg(y) over w) / nullif(stddev_samp(y) over w, 0) as z, avg(y) over w as mu,
  stddev_samp(y) over w as sigma from fx_hourly window w as (partition by region_id)"""


@query("w8_zscore", f"select region_id, ts, round(z, 6) as z from ({_Z}) t")
def zscore(v):
    return rounded(panel.zscore(v.hourly, R, "y").select("region_id", "ts", "z"), 6)


@query("w9_denormalize", f"select region_id, ts, round(z * 2 * sigma + mu, 5) as y from ({_Z}) t")
def denormalize(v):
    z = panel.zscore(v.hourly, R, "y")
    back = panel.denormalize(F.col("z") * 2, F.col("mu"), F.col("sigma"))
    return rounded(z.select("region_id", "ts", back.alias("y")), 5)


@query("w10_minmax_scale", """
with t as (select min(cf) as lo, max(cf) as hi from fx_daily where d < date '2000-01-01')
select d, round((cf - lo) / (hi - lo), 7) as scaled, round(cf, 7) as back from fx_daily, t""")
def minmax_scale(v):
    s = panel.minmax_scale(v.daily, v.daily.filter("d < date '2000-01-01'"), "cf", "scaled")
    back = panel.minmax_inverse(F.col("scaled"), F.col("scaled_lo"), F.col("scaled_hi"))
    return rounded(s.select("d", "scaled", back.alias("back")), 7)


@query("w11_standardize", """
with f as (select region_id, ts, y, lag(y, 1) over (partition by region_id order by ts) as lag_1,
  row_number() over (partition by region_id order by ts) - 1 as i, count(*) over (partition by region_id) as n from fx_hourly_dense),
s as (select avg(y) as m1, stddev_samp(y) as s1, avg(lag_1) as m2, stddev_samp(lag_1) as s2 from f
  where lag_1 is not null and i < floor(n * 0.6::double))
select region_id, ts, round((y - m1) / s1, 5) as z_y, round((lag_1 - m2) / s2, 5) as z_lag_1 from f, s where lag_1 is not null""")
def standardize(v):
    from wattframe.operators.splits import chronological_split

    d = chronological_split(dense(v), R, "ts", F.col("ts").cast("date"))
    f = panel.over_chunks(d, R, "pos", lambda w: [F.lag("y", 1).over(w).alias("lag_1")], back=1).filter("lag_1 is not null")
    x = VectorAssembler(inputCols=["y", "lag_1"], outputCol="features").transform(f)
    fitted = StandardScaler(inputCol="features", outputCol="scaled", withMean=True, withStd=True).fit(
        x.filter("split = 'train'"))
    z = vector_to_array("scaled")
    return rounded(fitted.transform(x).select("region_id", "ts", z[0].alias("z_y"), z[1].alias("z_lag_1")), 5)


KINDS = ("click", "error", "purchase", "signup", "view")  # the series of the wide load view


@query("w12_impute_median", """
with m as (select """ + ", ".join(f"median({k}_load_actual) as m_{k}" for k in KINDS) + """ from fx_load_wide where ts < timestamp '2024-01-20')
select ts, """ + ", ".join(f"round(coalesce({k}_load_actual, m_{k}, 0), 4) as {k}" for k in KINDS) + """
from fx_load_wide, m""")
def impute(v):
    w = v.load_wide.select("ts", *[F.col(f"{k}_load_actual").alias(k) for k in KINDS])
    return rounded(impute_median(w, w.filter("ts < timestamp_ntz'2024-01-20'"), list(KINDS)), 4)


@query("w13_difference", """
select region_id, ts, round(y - lag(y, 1) over w, 4) as diff_1, round(y - lag(y, 24) over w, 4) as diff_24
from fx_hourly_dense window w as (partition by region_id order by ts)""")
def difference(v):
    return rounded(panel.difference(dense(v), R, "pos", "y", [1, 24], dense=True).select("region_id", "ts", "diff_1", "diff_24"), 4)


@query("w14_rank_desc", "select site, round(volume, 2) as volume, rank() over (order by volume desc) as rank from fx_sites")
def rank_desc(v):
    return rounded(with_rank(v.sites.select("site", "volume"), [], "volume"), 2)


@query("w14_rank_orders", """
select o_orderkey, rank() over (partition by o_orderstatus order by o_totalprice desc) as rank from orders""")
def rank_orders(v):
    o = v.t("orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return with_rank(o, ["o_orderstatus"], "o_totalprice", stored=True).select("o_orderkey", "rank")


@query("w15_row_index", "select region_id, ts, row_number() over (partition by region_id order by ts) - 1 as idx from fx_hourly")
def row_index(v):
    return panel.with_row_index(v.hourly, R, ["ts"], F.col("ts").cast("date")).select("region_id", "ts", "idx")


@query("w16_gap_cluster", f"with {CLUSTER_SQL} select page, y0, x0, txt, cluster::bigint as cluster from cl")
def gap_cluster(v):
    t = rel.tag_tokens(v.tokens).filter("kind is not null")
    return panel.gap_clusters(t, ["page"], "y0", "x0", 6.0).select("page", "y0", "x0", "txt", "cluster")


@query("w17_token_tagging", f"with {TAG_SQL} select page, x0, y0, txt, kind, case when kind is not null then num end as num from tagged")
def token_tagging(v):
    return rel.tag_tokens(v.tokens).select("page", "x0", "y0", "txt", "kind", "num")


_ACF = """d as (select region_id, ts, y - avg(y) over (partition by region_id) as x from fx_hourly_dense),
c as (select a.region_id, k.lag, sum(a.x * b.x) as c from d a cross join (select unnest(range(1, 25)) as lag) k
  join d b on a.region_id = b.region_id and b.ts = a.ts - to_hours(k.lag) group by 1, 2),
z as (select region_id, sum(x * x) as c0, count(*) as n from d group by 1),
acf as (select c.region_id, c.lag::int as lag, n, c / c0 as acf from c join z using (region_id))"""


@query("w18_acf", f"with {_ACF} select region_id, lag, n, round(acf, 6) as acf from acf")
def acf(v):
    return rounded(panel.autocorrelation(dense(v), R, "pos", "y", 24, dense=True), 6)


@query("w18_pacf")
def pacf(v):
    return rounded(panel.partial_autocorrelation(panel.autocorrelation(dense(v), R, "pos", "y", 24, dense=True), R), 6)


@query("w19_ljung_box", f"""
with {_ACF} select region_id, max(lag) as m, max(n) as n, round(max(n) * (max(n) + 2) * sum(acf * acf / (n - lag)), 4) as q_stat
from acf group by 1""")
def ljung_box(v):
    return rounded(panel.ljung_box(panel.autocorrelation(dense(v), R, "pos", "y", 24, dense=True), R), 4)


@query("w20_feature_matrix", """
select region_id, ts, 4 as n_features, round(y + is_filled + hour(ts) + isodow(ts) - 1, 4) as feature_sum from fx_hourly_dense""")
def feature_matrix(v):
    from wattframe.functions.calendar import with_parts

    d = with_parts(v.dense, "ts", ["hour", "dow"])
    cols = panel.numeric_columns(d, drop=["region_id", "ts"])
    x = VectorAssembler(inputCols=cols, outputCol="features", handleInvalid="keep").transform(d)
    arr = vector_to_array("features")
    total = F.aggregate(arr, F.lit(0.0), lambda a, b: a + b)
    return rounded(x.select("region_id", "ts", F.size(arr).alias("n_features"), total.alias("feature_sum")), 4)
