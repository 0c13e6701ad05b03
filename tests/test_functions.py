"""Scalar functions on hand-made values."""

import math

import pytest
from pyspark.sql import functions as F

from wattframe.functions import calendar, clean, resource
from wattframe.functions.tails import incomplete_beta, normal_p, p_value, student_p


def col(spark, values, expr, kind="string"):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(values)], f"i int, x {kind}")
    return [r["r"] for r in df.select("i", expr(F.col("x")).alias("r")).orderBy("i").collect()]


@pytest.mark.parametrize("fn,pairs", [
    (clean.parse_number, {"-": None, "—": None, "…": None, " 12,5 ": 12.5, "1 234": 1234.0, "1 234,5": 1234.5, "1,234.50": None,
                          "NaN": None, "": None, "7": 7.0, "1e3": 1000.0, "5d": None}),
    (clean.parse_number_grouped, {"1,234.50": 1234.5, "1 234,5": 1234.5, "12,5": 12.5, "-1,234": -1234.0, "abc": None}),
    (clean.parse_hour, {"0-1": 0, " 23 - 24": 23, "7": 7, "7.0": 7, "24": None, "x": None, "31-2": None}),
    (clean.classify_section, {"1. A": "1_total_supply", "Total energy supply": "1_total_supply", "total energy": None, "2. x": "2_transformation",
                              "Transformation": "2_transformation", "3. y": "3_final_consumption", "coal": None}),
    (clean.normalize_fuel_group, {"Natural gas2, million cubik meters": "Natural gas", "Heat, TJ": "Heat", "New fuel,": "New fuel"}),
    (clean.normalize_line_item, {"Imports (+)": "Imports", "Stock changes (+)": "Stock changes", "Odd label": "Odd label"}),
    (clean.strip_unit_suffix, {"Coal,\n thousand tons": "Coal", " Gas , GWh": "Gas", "Peat": "Peat"}),
    (clean.safe_column_name, {"A b-c (d)": "a_b_c_d", "***": "col", "x" * 80: "x" * 60}),
])
def test_text_functions(spark, fn, pairs):
    assert col(spark, list(pairs), fn) == list(pairs.values())


def test_longest_keyword_wins(spark):
    assert col(spark, ["север-юг", "Север", "none"], lambda c: clean.match_keyword(c, clean.ZONE_WORDS)) == ["North-South", "North", None]
    assert col(spark, ["север-юг"], lambda c: clean.match_keyword(c, clean.ZONE_WORDS, prefer="first")) == ["North"]


def test_encoding_repair(spark):
    good = ["Январь 2024", "Север", "plain"]
    bad = [good[0].encode().decode("cp866"), good[1].encode().decode("latin-1"), "plain"]
    assert col(spark, bad, clean.repair_encoding) == good


def test_names_are_safe_and_distinct():
    assert clean.safe_names(["A b", "a-b", "A_B", "?"]) == ["a_b", "a_b_1", "a_b_2", "col"]
    assert clean.safe_names(["a", "a", "a_1", "a_1", "a"]) == ["a", "a_2", "a_1", "a_1_1", "a_3"]


def test_number_rules(spark):
    assert col(spark, [1.0, float("inf"), float("nan"), None], clean.replace_infinite, "double") == [1.0, None, None, None]
    assert col(spark, [-1.0, 0.5, 3.0, None], lambda c: clean.clip(c, 0, 1), "double") == [0.0, 0.5, 1.0, None]


def test_sign_rule(spark):
    df = spark.createDataFrame([(-1.0, "Net Imports "), (-1.0, "coal"), (2.0, "coal"), (None, "coal")], "v double, c string")
    assert [(r["v"], r["sign_ok"]) for r in clean.sign_rule(df, "v", "c").collect()] == [(-1.0, True), (None, False), (2.0, True), (None, True)]


def test_capacity_factors(spark):
    assert col(spark, [2.9, 7.5, 12.0, 25.0, 25.1, None], resource.wind_capacity_factor, "double") == [0.0, 0.125, 1.0, 1.0, 0.0, None]
    assert col(spark, [500.0, 2000.0, -5.0], lambda c: resource.solar_capacity_factor(c, F.lit(0.0)), "double") == [0.5, 1.0, 0.0]
    assert col(spark, [0.0, 15.0, 30.0], resource.pue, "double") == pytest.approx([1.05, 1.14, 1.23])
    # 35 MW all year at 0.031 per kWh costs 9.50 M
    assert col(spark, [0.031], lambda c: resource.annual_opex(F.lit(35.0), c) / 1e6, "double")[0] == pytest.approx(9.50, abs=0.005)


def test_utc(spark):
    df = spark.sql("select timestamp_ntz'2024-03-01 05:00:00' as t")
    assert str(df.select(calendar.to_utc("t", "+05:00")).first()[0]) == "2024-03-01 00:00:00"


def test_tails(spark):
    assert normal_p(1.959963984540054) == pytest.approx(0.05)
    assert student_p(2.2281388519649385, 10) == pytest.approx(0.05)
    assert student_p(12.706204736432095, 1) == pytest.approx(0.05)
    assert incomplete_beta(2.0, 3.0, 0.5) == pytest.approx(0.6875)
    got = col(spark, [2.0, None], lambda c: p_value(c, F.lit(10)), "double")
    assert got[0] == pytest.approx(0.07338803, abs=1e-7) and got[1] is None
    assert not any(math.isnan(x) for x in col(spark, [0.0], lambda c: p_value(c), "double"))


def test_row_functions_apply_to_a_stream(spark, tmp_path):
    spark.createDataFrame([(3.0, 4.0)], "u double, v double").write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema("u double, v double").parquet(str(tmp_path / "in")).select(resource.wind_speed("u", "v").alias("ws"))
    q = s.writeStream.format("memory").queryName("ws_out").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(60)
    assert spark.sql("select * from ws_out").first()["ws"] == 5.0
