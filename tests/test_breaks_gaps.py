"""Breaks, gaps, names, token rows, tail probabilities and tree attributions against plain versions."""

import datetime as dt
import itertools
import math
import random
import unicodedata

import numpy as np
import pytest
from pyspark.sql import functions as F

from wattframe.functions import clean, tails
from wattframe.operators import decompose, learners, panel, quality, relational


def squares(y, cuts):
    edges = (0, *cuts, len(y))
    return sum(((y[a:b] - y[a:b].mean()) ** 2).sum() for a, b in zip(edges[:-1], edges[1:], strict=True))


def test_break_search_equals_trying_all_partitions():
    rng = np.random.default_rng(0)
    for k in range(150):
        n, m, trim = int(rng.integers(2, 22)), int(rng.integers(1, 4)), int(rng.integers(1, 4))
        y = rng.integers(0, 3, n).astype(float) if k % 3 == 0 else rng.normal(size=n) + 3 * (rng.random(n) < 0.3)
        fits = [c for c in itertools.combinations(range(trim, n - trim + 1), m) if min(np.diff((0, *c, n))) >= trim]
        got = decompose._best_partition(y, m, trim)
        assert bool(got) == bool(fits)
        if fits:
            assert min(np.diff((0, *got, n))) >= trim and squares(y, got) == pytest.approx(min(squares(y, c) for c in fits), abs=1e-9)


def test_breaks_of_a_long_series_and_of_a_null_key(spark):
    rng = np.random.default_rng(1)
    level = np.repeat([0.0, 1.5, -1.0], [40_000, 25_000, 35_000])
    found = decompose._best_partition(level + rng.normal(size=100_000), 2, 24)
    assert abs(found[0] - 40_000) < 40 and abs(found[1] - 65_000) < 40
    rows = [(k, i, float((i >= 30) * 5 + i % 2)) for k in ("a", None) for i in range(60)] + [("short", 0, 1.0)]
    df = spark.createDataFrame(rows, "k string, t int, y double")
    got = decompose.multi_break(df, ["k"], "t", "y", 1).collect()
    assert {(r.k, r.n_before, r.last_period) for r in got} == {("a", 30, 29), (None, 30, 29)}
    single = decompose.sup_f(df.filter("k is null or k = 'a'"), ["k"], "t", F.floor(F.col("t") / 16), "y").collect()
    assert {(r.k, r.n_before) for r in single} == {("a", 30), (None, 30)}


@pytest.mark.parametrize("unit,seconds", [("minute", 60), ("hour", 3600), ("day", 86400)])
@pytest.mark.parametrize("per_series", [False, True])
def test_gaps_equal_the_grid(spark, unit, seconds, per_series):
    rng = random.Random(2)
    start = dt.datetime(2023, 12, 30)
    kept = {k: [i for i in range(n) if rng.random() > 0.4] for k, n in (("a", 120), (None, 90), ("b", 30))}
    rows = [(k, start + dt.timedelta(seconds=seconds * i), float(i)) for k, own in kept.items() for i in own]
    df = spark.createDataFrame(rows + rows[:3], "k string, ts timestamp_ntz, y double")
    lo, hi = min(map(min, kept.values())), max(map(max, kept.values()))
    want = {(k, start + dt.timedelta(seconds=seconds * i)) for k, own in kept.items()
            for i in (range(min(own), max(own) + 1) if per_series else range(lo, hi + 1)) if i not in own}
    gaps = panel.gap_intervals(df, ["k"], "ts", unit, per_series)
    assert {tuple(r) for r in panel.expand_gaps(gaps, ["k"], "ts", unit, chunk=3).collect()} == want
    assert gaps.agg(F.sum("n_missing")).first()[0] == len(want) and gaps.count() < len(want)
    filled = panel.fill_gaps(df, ["k"], "ts", unit, per_series)
    assert filled.columns == df.columns and filled.count() == len(rows) + 3 + len(want) and filled.filter("y is null").count() == len(want)


def test_a_gap_of_decades_in_minutes_is_one_row(spark):
    df = spark.sql("select timestamp_ntz'1990-01-01 00:00:00' as ts union all select timestamp_ntz'2020-01-01 00:00:00' union all select cast(null as timestamp_ntz)")
    gap = panel.gap_intervals(df, [], "ts", "minute").collect()
    assert [(r.n_missing, r.gap_start.minute) for r in gap] == [(int((dt.datetime(2020, 1, 1) - dt.datetime(1990, 1, 1)).total_seconds() // 60) - 1, 1)]


def plain_names(bases):
    first, count, taken, out = {}, {}, set(), []
    for b in bases:
        if b is not None:
            first.setdefault(b.lower(), b)
    seen = set()
    for b in bases:
        if b is None:
            out.append(None)
        elif b.lower() not in seen:
            seen.add(b.lower())
            out.append(b)
        else:
            n = count.get(b.lower(), 0) + 1
            while f"{b.lower()}_{n}" in first:
                n += 1
            count[b.lower()] = n
            out.append(f"{b}_{n}")
    return out


def test_numbered_names_never_repeat(spark):
    rng = random.Random(3)
    cases = [["a", "a", "a_1"], ["a_1", "A", "a", "a_2", "a", "A_1", None, "a_1"], [rng.choice(["x", "X_1", "x_1", "x_3", "x_1_1", "y_01", "y"]) for _ in range(60)]]
    for bases in cases:
        df = spark.createDataFrame(list(enumerate(bases)), "i long, base string")
        got = [r.name for r in clean.numbered_duplicates(df, "base", "i", "name", chunk=4).orderBy("i").collect()]
        assert got == plain_names(bases)
        named = [g.lower() for g in got if g is not None]
        assert len(set(named)) == len(named)


def test_number_grammar(spark):
    texts = ["1,234.5", "1 234,5", "-1,234", "12,5", "1,23", "1 23", "1234", "12,345,678", "1,234,5", "-", "", "1.2.3", ",5", "5,", "1 234 567.25", "-12 345", "999.1", "abc", None, "1e3", "1,234e1"]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    got = {r.t: (r.a, r.b) for r in df.select("t", clean.parse_number_grouped("t").alias("a"), clean.token_number("t").alias("b")).collect()}
    assert got == {"1,234.5": (1234.5, 1234.5), "1 234,5": (1234.5, 1234.5), "-1,234": (-1234.0, -1234.0), "12,5": (12.5, 12.5), "1,23": (1.23, 1.23), "1 23": (None, None), "1234": (1234.0, None),
                   "12,345,678": (12345678.0, 12345678.0), "1,234,5": (None, None), "-": (None, None), "": (None, None), "1.2.3": (None, None), ",5": (0.5, None), "5,": (5.0, None),
                   "1 234 567.25": (1234567.25, 1234567.25), "-12 345": (-12345.0, -12345.0), "999.1": (999.1, 999.1), "abc": (None, None), None: (None, None), "1e3": (1000.0, None),
                   "1,234e1": (pytest.approx(12.34), None)}


def test_normal_form_of_all_pairs(spark):
    pairs = clean.composition_pairs()
    assert len(pairs) > 500 and all(unicodedata.normalize("NFC", k) == v for k, v in pairs.items())
    texts = [*pairs, "".join(pairs), "й й é̂ x́", "", None, "́a", "plain"]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string")
    got = {r.i: r.n for r in df.select("i", clean.normal_form("t").alias("n")).collect()}
    assert all(got[i] == (t and unicodedata.normalize("NFC", t)) for i, t in enumerate(texts))
    word = "Энергия й é"
    mangled = spark.createDataFrame([(word,)], "t string").select(*[clean.repair_encoding(clean.mangled("t", c)).alias(c.replace("-", "")) for c in ("cp866", "latin-1")]).first()
    assert mangled.cp866 == mangled.latin1 == unicodedata.normalize("NFC", word)


def test_a_page_of_many_tokens(spark):
    years = [("p", 100.0, 40.0 * i, str(2018 + i)) for i in range(5)]
    near = [("p", 80.0, 40.0 * i + 5, str(60 + i)) for i in range(5)]
    far = [("p", 150.0, 40.0 * i, str(90 + i)) for i in range(5)]
    crowd = [("p", 1000.0 + 10 * (i // 40), 10.0 * (i % 40), str(50 + i % 90)) for i in range(100_000)]
    df = spark.createDataFrame(years + near + far + crowd + [(None, *r[1:]) for r in years + near], "page string, y double, x double, txt string")
    rows = panel.gap_clusters(relational.tag_tokens(df).filter("kind is not null"), ["page"], "y", "x", 6.0)
    got = relational.align_token_rows(rows, "page", "y", "x", "cluster").collect()
    assert {(r.page, r.year, r.value) for r in got} == {(p, 2018 + i, 60.0 + i) for p in ("p", None) for i in range(5)} and len(got) == 10


def test_tails_in_columns(spark):
    points = [("z", 1.6448536269514722, None, 0.1), ("z", 2.5758293035489004, None, 0.01), ("z", 0.0, None, 1.0), ("z", 6.0, None, math.erfc(6 / math.sqrt(2))),
              ("t", 6.313751514675041, 1, 0.1), ("t", -2.2281388519649385, 10, 0.05), ("t", 2.0, 30, tails.student_p(2.0, 30)), ("t", 0.1, 5, tails.student_p(0.1, 5)), ("t", 3.3, 1_000_000, tails.student_p(3.3, 1_000_000)),
              ("c", 3.841458820694124, 1, 0.05), ("c", 18.307038053275146, 10, 0.05), ("c", 124.34211340400407, 100, 0.05), ("c", 0.0, 3, 1.0)]
    df = spark.createDataFrame([(k, s, n, p) for k, s, n, p in points] + [("z", None, None, None)], "k string, s double, n long, p double")
    found = F.when(F.col("k") == "c", tails.chi_square_tail(F.col("s"), F.col("n"))).otherwise(tails.p_value("s", F.when(F.col("k") == "t", F.col("n"))))
    for r in df.withColumn("got", found).collect():
        assert r.got == (None if r.p is None else pytest.approx(r.p, rel=1e-8, abs=1e-14)), r
    assert "Python" not in df.select(found)._jdf.queryExecution().executedPlan().toString()


def test_null_keys_in_comparisons(spark):
    a = spark.createDataFrame([("x", 1.0), (None, 2.0)], "k string, v double")
    b = spark.createDataFrame([(None, 2.0), ("y", 3.0)], "k string, v double")
    assert {(r.k, r.status) for r in relational.parity(a, b, ["k"], "v").collect()} == {("x", "only_a"), (None, "match"), ("y", "only_b")}
    assert {(r.k, r.v) for r in relational.combine_first(a, b, ["k"], ["v"]).collect()} == {("x", 1.0), (None, 2.0)}
    assert {r.k: r.matched for r in relational.tolerance_flag(a, b, ["k"], "v", 0.5).collect()} == {"x": False, None: True}
    assert {r.k: r.ok for r in quality.slice_parity(a, b, ["k"], "v").collect()} == {"x": False, None: True, "y": False}


def test_contributions_are_shapley_values_and_add_up(spark):
    rng = np.random.default_rng(4)
    names = [f"f{i}" for i in range(6)]
    x = rng.normal(size=(200, 6))
    y = 2 * (x[:, 0] > 0) + x[:, 1] * (x[:, 2] > 0.3) + 0.5 * (x[:, 5] > 0) * (x[:, 0] > 0)
    df = spark.createDataFrame([(i, *map(float, r), float(t)) for i, (r, t) in enumerate(zip(x, y, strict=True))], "id long, " + ", ".join(f"{n} double" for n in names) + ", y double").coalesce(1)
    model = learners.fit_gbt(df, names, "y", maxDepth=4, maxIter=3, stepSize=0.5)
    got = learners.contributions(model, df, names, ["id"]).orderBy("id").collect()
    for r in got:
        assert r.y_pred == pytest.approx(r["mean"] + sum(r[f"by_{n}"] for n in names))
    trees = [(w, t._call_java("rootNode")) for w, t in zip(model.stages[-1].treeWeights, model.stages[-1].trees, strict=True)]

    def value(node, row, known):
        if node.subtreeDepth() == 0:
            return node.prediction()
        f, at, n = node.split().featureIndex(), node.split().threshold(), node.impurityStats().count()
        if f in known:
            return value(node.leftChild() if row[f] <= at else node.rightChild(), row, known)
        return sum(value(c, row, known) * c.impurityStats().count() / n for c in (node.leftChild(), node.rightChild()))

    for i in (0, 17):
        worth = {s: sum(w * value(t, x[i], s) for w, t in trees) for k in range(7) for s in map(frozenset, itertools.combinations(range(6), k))}
        for f in range(6):
            want = sum(math.factorial(len(s)) * math.factorial(5 - len(s)) / 720 * (worth[s | {f}] - worth[s]) for s in worth if f not in s)
            assert got[i][f"by_{names[f]}"] == pytest.approx(want, abs=1e-9)
