"""Chunked series primitives equal the plain window, also when one series holds most rows."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from wattframe.operators import panel, quantiles as qt


@pytest.fixture(scope="module")
def series(spark):
    rng = np.random.default_rng(7)
    rows = []
    for name, n in (("hot", 300), ("b", 40), ("c", 3)):
        for i in range(n):
            rows.append((name, i, None if rng.random() < 0.2 else float(np.round(rng.normal(), 3))))
    return spark.createDataFrame(rows, "k string, i bigint, y double").cache()


def same(a, b, cols):
    pa, pb = (d.select(*cols).toPandas().sort_values(["k", "i"]).reset_index(drop=True) for d in (a, b))
    pd.testing.assert_frame_equal(pa, pb, check_dtype=False)


@pytest.mark.parametrize("chunk", [7, 50, 10_000])
def test_over_chunks_equals_window(series, chunk):
    def build(w):
        return [F.lag("y", 5).over(w).alias("a"), F.lead("y", 3).over(w).alias("b"), F.sum("y").over(w.rowsBetween(-5, 2)).alias("s")]

    w = W.partitionBy("k").orderBy("i")
    got = panel.over_chunks(series, ["k"], "i", build, back=5, ahead=3, chunk=chunk)
    assert got.count() == series.count()
    same(got, series.select("*", *build(w)), ["k", "i", "a", "b", "s"])


def test_row_index_running_sums_and_fill(series):
    w = W.partitionBy("k").orderBy("i")
    shifted = series.withColumn("j", F.col("i") * 3 + 11)
    got = panel.with_row_index(shifted, ["k"], ["j"], F.floor(F.col("j") / 20), total="n")
    want = shifted.withColumn("idx", F.row_number().over(w) - 1).withColumn("n", F.count("*").over(W.partitionBy("k")))
    same(got, want, ["k", "i", "idx", "n"])
    run = panel.with_running_sums(series.na.fill(0.0), ["k"], ["i"], F.floor(F.col("i") / 9), {"s": F.col("y")})
    same(run.withColumn("s", F.round("s", 9)), series.na.fill(0.0).withColumn("s", F.round(F.sum("y").over(w.rowsBetween(W.unboundedPreceding, 0)), 9)), ["k", "i", "s"])
    fill = panel.with_fill_forward(series, ["k"], "i", F.floor(F.col("i") / 4), "y", "f")
    same(fill, series.withColumn("f", F.last("y", True).over(w.rowsBetween(W.unboundedPreceding, 0))), ["k", "i", "f"])


def test_row_index_without_keys(series):
    got = panel.with_row_index(series, [], ["k", "i"], F.col("k"), total="n").toPandas().sort_values(["k", "i"])
    assert got["idx"].tolist() == list(range(343)) and set(got["n"]) == {343}


def test_left_closed_features_ignore_the_current_value(series):
    def left(df):
        return panel.over_chunks(df, ["k"], "i", lambda w: [panel.rolling(w, "y", 4, closed="left").alias("m")], back=5)

    bumped = series.withColumn("y", F.when((F.col("k") == "b") & (F.col("i") == 20), 1e6).otherwise(F.col("y")))
    a = left(series).filter("k = 'b' and i = 20").first()["m"]
    assert a == left(bumped).filter("k = 'b' and i = 20").first()["m"]
    assert left(bumped).filter("k = 'b' and i = 21").first()["m"] > 1000


@pytest.mark.parametrize("h,want", [(1, 23), (24, 0), (25, 23), (36, 12)])
def test_seasonal_shift(h, want):
    assert panel.seasonal_shift(h) == want


def test_zscore_round_trip(series):
    z = panel.zscore(series.filter("y is not null"), ["k"], "y")
    s = z.groupBy("k").agg(F.avg("z").alias("m"), F.stddev_samp("z").alias("s")).filter("k <> 'c'").collect()
    assert all(abs(r["m"]) < 1e-9 and abs(r["s"] - 1) < 1e-9 for r in s)
    back = z.withColumn("d", F.abs(panel.denormalize(F.col("z"), F.col("mu"), F.col("sigma")) - F.col("y")))
    assert back.agg(F.max("d")).first()[0] < 1e-9


def test_quantiles_equal_numpy(spark):
    rng = np.random.default_rng(3)
    hot = np.concatenate([np.full(400, 2.5), rng.normal(size=900)])  # one value holds a third of the rows
    rows = [("hot", float(x)) for x in hot] + [("few", float(x)) for x in (4.0, 1.0, 9.0)] + [("one", 5.0), ("one", None)]
    df = spark.createDataFrame(rows, "k string, v double")
    got = {r["k"]: r for r in qt.quantiles(df, ["k"], "v", {"a": 0.1, "m": 0.5, "z": 0.93, "lo": 0.0, "hi": 1.0}).collect()}
    for k, vals in (("hot", hot), ("few", [4.0, 1.0, 9.0]), ("one", [5.0])):
        for c, q in (("a", 0.1), ("m", 0.5), ("z", 0.93), ("lo", 0.0), ("hi", 1.0)):
            assert got[k][c] == pytest.approx(np.quantile(vals, q), abs=1e-12), (k, c)
    total = qt.quantiles(df, [], "v", {"m": 0.5}).first()
    assert total["m"] == pytest.approx(np.median([r[1] for r in rows if r[1] is not None]))


@pytest.mark.parametrize("ascending", [False, True])
def test_rank_equals_sql_rank(spark, ascending):
    rng = np.random.default_rng(5)
    rows = [("a" if i % 3 else "b", float(rng.integers(0, 40)), i) for i in range(500)]
    df = spark.createDataFrame(rows, "k string, v double, i int")
    order = F.col("v").asc() if ascending else F.col("v").desc()
    want = df.withColumn("rank", F.rank().over(W.partitionBy("k").orderBy(order)).cast("bigint"))
    same(qt.with_rank(df, ["k"], "v", ascending=ascending), want, ["k", "i", "rank"])
    want = df.withColumn("rank", F.rank().over(W.orderBy(order)).cast("bigint"))
    same(qt.with_rank(df, [], "v", ascending=ascending), want, ["k", "i", "rank"])


def test_partial_autocorrelation(spark):
    rng = np.random.default_rng(1)
    y = [0.0]
    for _ in range(600):
        y.append(0.7 * y[-1] + rng.normal())
    df = spark.createDataFrame([("s", i, float(v)) for i, v in enumerate(y)], "k string, i bigint, y double")
    acf = panel.autocorrelation(df, ["k"], "i", "y", 6)
    rho = [r["acf"] for r in acf.orderBy("lag").collect()]
    x = np.array(y) - np.mean(y)
    assert rho == pytest.approx([np.sum(x[k:] * x[:-k]) / np.sum(x * x) for k in range(1, 7)])
    pacf = [r["pacf"] for r in panel.partial_autocorrelation(acf, ["k"]).orderBy("lag").collect()]
    for k in range(1, 7):
        m = np.array([[1.0 if i == j else rho[abs(i - j) - 1] for j in range(k)] for i in range(k)])
        assert pacf[k - 1] == pytest.approx(np.linalg.solve(m, rho[:k])[-1])


def test_hot_series_is_split_over_tasks(series):
    """The window runs on (series, chunk) groups, so no group is longer than a chunk and its overlap."""
    got = panel.over_chunks(series, ["k"], "i", lambda w: [F.count("*").over(w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)).alias("n")],
                            back=5, chunk=20)
    assert got.agg(F.max("n")).first()[0] <= 25


def test_hour_grid_keeps_its_phase_over_days(spark):
    df = spark.sql("""select * from values ('a', timestamp_ntz'2024-02-28 05:30:00'), ('a', timestamp_ntz'2024-03-02 03:30:00'),
                      ('b', timestamp_ntz'2024-03-01 00:30:00') t(k, ts)""")
    for per_series, want in ((True, {"a": 71, "b": 1}), (False, {"a": 71, "b": 71})):
        g = panel.series_grid(df, ["k"], "ts", "hour", per_series).toPandas()
        assert g.groupby("k").size().to_dict() == want and not g.duplicated().any()
        one = g[g.k == "a"].ts.sort_values()
        assert set(one.diff().dropna()) == {pd.Timedelta(hours=1)} and str(one.iloc[-1]) == "2024-03-02 03:30:00"
    missing = panel.missing_steps(df, ["k"], "ts", "hour", per_series=True)
    assert missing.count() == 69
