"""Operators against brute force and their invariants."""

import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.operators import decompose, disagg, forecast as fc, metrics, relational as rel, reshape, splits
from wattframe.operators.imputation import impute_median


def test_tolerance_flag_equals_pair_scan(spark):
    rng = np.random.default_rng(2)
    a = [(int(y), float(v)) for y, v in zip(rng.integers(0, 3, 200), np.round(rng.uniform(-10, 10, 200), 2))]
    b = [(int(y), float(v)) for y, v in zip(rng.integers(0, 3, 30), np.round(rng.uniform(-10, 10, 30), 2))] + [(9, 1.0)]
    for tol in (0.1, 0.75, 5.0):
        got = rel.tolerance_flag(spark.createDataFrame(a, "y int, v double"), spark.createDataFrame(b, "y int, v double"), ["y"], "v", tol)
        want = sorted((y, v, any(y == q and abs(v - w) <= tol for q, w in b)) for y, v in a)
        assert sorted(tuple(r) for r in got.collect()) == want


def test_keep_first_and_last_with_many_copies(spark):
    rows = [("hot", i, f"v{i}") for i in range(200)] + [("a", 5, "x"), (None, 1, "n1"), (None, 2, "n2")]
    df = spark.createDataFrame(rows, "k string, o int, v string")
    assert sorted(tuple(r) for r in splits.keep_first(df, ["k"], ["o"]).collect() if r["k"]) == [("a", 5, "x"), ("hot", 0, "v0")]
    assert {r["k"]: r["v"] for r in splits.keep_last(df, ["k"], ["o"]).collect()} == {"hot": "v199", "a": "x", None: "n2"}


def test_split_keeps_order_and_all_rows(spark):
    df = spark.range(103).select(F.col("id").alias("t"))
    s = splits.chronological_split(df, [], "t", F.floor(F.col("t") / 10)).groupBy("split").agg(
        F.count("*").alias("n"), F.min("t").alias("a"), F.max("t").alias("z"))
    assert {r["split"]: (r["n"], r["a"], r["z"]) for r in s.collect()} == {"train": (61, 0, 60), "val": (21, 61, 81), "test": (21, 82, 102)}


def test_capped_sample_repeats(spark):
    df = spark.range(1000)
    a = [r["id"] for r in splits.capped_sample(df, ["id"], 50).collect()]
    assert a == sorted(a) and len(a) == 50 and a == [r["id"] for r in splits.capped_sample(df.repartition(7), ["id"], 50).collect()]


def test_unpivot_of_pivot_is_identity(spark):
    df = spark.createDataFrame([(i, c, float(i * 10 + j)) for i in range(4) for j, c in enumerate("xyz")], "i int, c string, v double")
    wide = reshape.pivot(df, ["i"], "c", F.sum("v"))
    assert sorted(reshape.melt(wide, ["i"], ["x", "y", "z"], "c", "v").collect()) == sorted(df.collect())


def test_histogram_closes_the_last_bin(spark):
    df = spark.createDataFrame([(x,) for x in (0.0, 1.0, 2.0, 3.0, 3.5, -1.0)], "x double")
    assert [r["n"] for r in rel.histogram(df, "x", [0, 1, 2, 3]).orderBy("bin").collect()] == [1, 1, 2]


def test_impute_uses_training_medians(spark):
    train = spark.createDataFrame([(1.0, None), (2.0, None), (9.0, None)], "a double, b double")
    got = impute_median(spark.createDataFrame([(None, None), (5.0, 1.0)], "a double, b double"), train, ["a", "b"]).collect()
    assert [tuple(r) for r in got] == [(2.0, 0.0), (5.0, 1.0)]


def test_disaggregation_conserves_the_month(spark):
    monthly = spark.createDataFrame([("a", 2024, 2, 10.0), ("b", 2023, 2, 3.0), ("a", 2024, 3, 0.5)], "z string, yr int, mo int, total double")
    profile = spark.createDataFrame([(2, d, h, float(h - 2)) for d in range(7) for h in range(24) if d != 3], "month int, dow int, hour int, weight double")
    out = disagg.disaggregate(monthly, profile, "total", keys=("z",))
    s = {(r["z"], r["yr"], r["mo"]): r for r in out.groupBy("z", "yr", "mo").agg(
        F.sum("load_mw").alias("s"), F.count("*").alias("n"), F.min("load_mw").alias("lo"), F.max("load_mw").alias("hi")).collect()}
    assert {k: v["n"] for k, v in s.items()} == {("a", 2024, 2): 696, ("b", 2023, 2): 672, ("a", 2024, 3): 744}
    assert s["a", 2024, 2]["s"] == pytest.approx(10_000) and s["b", 2023, 2]["s"] == pytest.approx(3_000)
    assert s["a", 2024, 3]["lo"] == pytest.approx(s["a", 2024, 3]["hi"]) and s["a", 2024, 2]["lo"] == 0.0


# --- metrics ------------------------------------------------------------------------------------------------

@pytest.fixture(scope="module")
def errors(spark):
    rng = np.random.default_rng(11)
    rows = [(s, i, float(rng.normal()), float(rng.normal(scale=1.3))) for s in ("a", "b") for i in range(60)]
    return spark.createDataFrame(rows, "s string, i bigint, e_a double, e_b double").withColumn("g", F.lit(1)).cache()


def dm_by_hand(errors, h, variance):
    pdf = errors.toPandas().sort_values(["s", "i"])
    pdf["d"] = pdf.e_a ** 2 - pdf.e_b ** 2
    d, n = pdf.d.to_numpy(), len(pdf)
    parts = [g.d.to_numpy() for _, g in pdf.groupby("s")]
    v = d.var(ddof=1) if variance != "bartlett" else d.var()
    for k in range(1, h):
        x, y = np.concatenate([p[k:] for p in parts]), np.concatenate([p[:-k] for p in parts])
        if variance == "flat":
            v += 2 * np.cov(x, y)[0, 1]
        elif variance == "bartlett":
            v += 2 * (1 - k / h) * np.sum((x - d.mean()) * (y - d.mean())) / n
    return d.mean() / np.sqrt(max(v, 1e-12) / n) * np.sqrt((n + 1 - 2 * h + h * (h - 1) / n) / n)


@pytest.mark.parametrize("variance,h", [("iid", 1), ("flat", 6), ("bartlett", 6)])
def test_diebold_mariano(errors, variance, h):
    got = metrics.diebold_mariano(errors, ["g"], ["s"], "i", h, variance).first()["dm_stat"]
    assert got == pytest.approx(dm_by_hand(errors, h, variance), rel=1e-9)
    swapped = errors.select("g", "s", "i", F.col("e_b").alias("e_a"), F.col("e_a").alias("e_b"))
    assert metrics.diebold_mariano(swapped, ["g"], ["s"], "i", h, variance).first()["dm_stat"] == pytest.approx(-got, rel=1e-9)


def test_dm_needs_eight_rows_and_variance(spark, errors):
    assert metrics.diebold_mariano(errors.filter("i < 3"), ["g"], ["s"], "i").first()["dm_stat"] is None
    same = errors.withColumn("e_b", F.col("e_a"))
    assert metrics.diebold_mariano(same, ["g"], ["s"], "i", 1, "iid").first()["dm_stat"] is None


def test_scores(spark):
    df = spark.createDataFrame([(0.0, 0.0), (2.0, 1.0), (4.0, 6.0)], "y_true double, y_pred double")
    r = metrics.score(df, []).first()
    assert (r["mae"], r["rmse"]) == (1.0, pytest.approx(np.sqrt(5 / 3)))
    assert r["smape_pct"] == pytest.approx(100 * np.mean([2 / 3, 0.4])) and r["r2"] == pytest.approx(1 - 5 / 8)


def test_mase_of_the_in_sample_naive_is_one(spark):
    rng = np.random.default_rng(4)
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(rng.normal(size=80))], "k string, i bigint, y double")
    from wattframe.operators.panel import over_chunks
    from pyspark.sql.functions import lag

    naive = over_chunks(df, ["k"], "i", lambda w: [lag("y", 24).over(w).alias("p")], back=24).filter("p is not null")
    m = naive.groupBy("k").agg(metrics.mae("y", "p").alias("mae"))
    assert metrics.with_mase(m, metrics.mase_scale(df, ["k"], "i", "y", 24), ["k"]).first()["mase"] == pytest.approx(1.0)
    short = metrics.mase_scale(df.filter("i < 10"), ["k"], "i", "y", 24).first()["mase_scale"]
    assert short == pytest.approx(np.mean(np.abs(np.diff([r["y"] for r in df.filter("i < 10").orderBy("i").collect()]))))


# --- forecasts ----------------------------------------------------------------------------------------------

def holt_by_hand(y, a, b):
    level, trend, sse = y[0], y[1] - y[0], 0.0
    for v in y[1:]:
        sse += (v - level - trend) ** 2
        new = a * v + (1 - a) * (level + trend)
        trend = b * (new - level) + (1 - b) * trend
        level = new
    return level, trend, sse


def test_holt_scan_equals_recursion(spark):
    rng = np.random.default_rng(9)
    ys = {"a": rng.normal(size=90).cumsum() + 20, "b": rng.normal(size=35) + 3}
    df = spark.createDataFrame([(k, i, float(v)) for k, y in ys.items() for i, v in enumerate(y)], "k string, i bigint, y double")
    cuts = spark.createDataFrame([("a", 0, 50), ("a", 1, 71), ("b", 0, 30)], "k string, fold int, cutoff bigint")
    st = fc.holt_states(df, cuts, ["k"], "i", "y", [0.2, 0.7], [0.1, 0.5], chunk=8)
    rows = st.collect()
    assert len(rows) == 12
    for r in rows:
        want = holt_by_hand(ys[r["k"]][:r["cutoff"]], r["alpha"], r["beta"])
        assert (r["level"], r["trend"], r["sse"]) == pytest.approx(want, rel=1e-8)
    best = {(r["k"], r["fold"]): (r["alpha"], r["beta"]) for r in fc.holt_search(st, ["k"]).collect()}
    for (k, f), pair in best.items():
        c = {("a", 0): 50, ("a", 1): 71, ("b", 0): 30}[k, f]
        assert pair == min(itertools.product([0.2, 0.7], [0.1, 0.5]), key=lambda p: holt_by_hand(ys[k][:c], *p)[2])


def test_ar_fourier_equals_least_squares(spark):
    rng = np.random.default_rng(6)
    n, p, k, period = 200, 2, 1, 24.0
    y = np.sin(2 * np.pi * np.arange(n) / 24) * 3 + rng.normal(size=n) + 10
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, i bigint, y double")
    fit = fc.fit_ar_fourier(df, ["k"], "i", "y", p, k, period)
    t = np.arange(p, n)
    x = np.column_stack([np.ones(n - p), y[1:-1], y[:-2], np.sin(2 * np.pi * t / period), np.cos(2 * np.pi * t / period)])
    coef = np.linalg.lstsq(x, y[p:], rcond=None)[0]
    assert fit.first()["coef"] == pytest.approx(coef, rel=1e-6)
    hist, want = list(y), []
    for i in range(n, n + 5):
        want.append(float(np.dot(coef, [1, hist[-1], hist[-2], np.sin(2 * np.pi * i / period), np.cos(2 * np.pi * i / period)])))
        hist.append(want[-1])
    got = fc.ar_fourier_forecast(fit, ["k"], 5, p, k, period).orderBy("step")
    assert [r["y_pred"] for r in got.collect()] == pytest.approx(want, rel=1e-6)


def test_conformal_band_covers_its_calibration_rows(spark):
    rng = np.random.default_rng(8)
    df = spark.createDataFrame([("m", float(a), float(b)) for a, b in rng.normal(size=(101, 2))], "model string, y_true double, y_pred double")
    for finite in (False, True):
        b = fc.conformal_band(df, df, ["model"], finite_sample=finite)
        assert b.agg(metrics.picp("y_true", "lo", "hi")).first()[0] >= 100 * (0.9 - 1 / 101)


# --- decomposition ------------------------------------------------------------------------------------------

def test_lmdi_effects_add_up_also_with_zeros(spark):
    rows = [("coal", 2019, 50.0, 60.0), ("coal", 2024, 40.0, 45.0), ("gas", 2019, 20.0, 8.0), ("gas", 2024, 35.0, 13.0),
            ("new", 2024, 10.0, 1.0), ("gone", 2019, 5.0, 2.0), ("wind", 2019, 1.0, 0.0), ("wind", 2024, 9.0, 0.0)]
    e = decompose.lmdi(spark.createDataFrame(rows, "f string, y int, g double, c double"), "f", "y", "g", "c", 2019, 2024)
    r = e.agg(F.sum(F.col("activity") + F.col("structure") + F.col("intensity")).alias("s"), F.sum("delta").alias("d")).first()
    assert r["d"] == pytest.approx(59.0 - 70.0) and r["s"] == pytest.approx(r["d"], abs=1e-6)


def test_breaks_equal_brute_force(spark):
    rng = np.random.default_rng(12)
    y = np.concatenate([rng.normal(0, 1, 12), rng.normal(5, 1, 9), rng.normal(-2, 1, 10)])
    df = spark.createDataFrame([("a", i, float(v)) for i, v in enumerate(y)], "k string, p int, y double")

    def ssr(x):
        return float(np.sum((x - x.mean()) ** 2))

    n = len(y)
    cuts = min(((i, j) for i in range(2, n) for j in range(i + 2, n - 1)), key=lambda c: ssr(y[:c[0]]) + ssr(y[c[0]:c[1]]) + ssr(y[c[1]:]))
    got = decompose.multi_break(df, ["k"], "p", "y", 2, 2).orderBy("break_no").collect()
    assert tuple(r["n_before"] for r in got) == cuts
    f = {t: (ssr(y) - ssr(y[:t]) - ssr(y[t:])) / ((ssr(y[:t]) + ssr(y[t:])) / (n - 2)) for t in range(3, n - 2)}
    r = decompose.sup_f(df, ["k"], "p", F.floor(F.col("p") / 5), "y", 3).first()
    assert r["n_before"] == max(f, key=f.get) and r["sup_f"] == pytest.approx(max(f.values()))


def test_topsis_prefers_a_dominating_site(spark):
    df = spark.createDataFrame([("best", 9.0, 1.0), ("mid", 5.0, 3.0), ("bad", 1.0, 8.0)], "s string, gain double, cost double")
    t = decompose.topsis(decompose.to_matrix(df, "s", ["gain", "cost"]), "s", {"gain": 2.0, "cost": 1.0}, {"gain": True, "cost": False})
    c = {r["s"]: (r["closeness"], r["rank"]) for r in t.collect()}
    assert c["best"] == (1.0, 1) and c["bad"] == (0.0, 3) and 0 < c["mid"][0] < 1


def test_scenarios_reach_their_targets(spark):
    base = spark.createDataFrame([("wind", 2024, 10.0)], "k string, y int, v double")
    p = decompose.scenario_projection(base, ["k"], "y", "v", [("up", 3.0, 2034)])
    r = {x["year"]: x for x in p.collect()}
    assert r[2024]["projected"] == 10.0 and r[2034]["projected"] == pytest.approx(30.0) and r[2030]["annual_need"] == pytest.approx(2.0)
