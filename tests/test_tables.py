"""Readers, writers, quality checks and jobs on hand-made tables."""

import pytest
from pyspark.sql import functions as F

from wattframe.operators import quality
from wattframe.plans import balance, market
from wattframe.sources import tables as io


def test_folder_scan_skips_empty_files_and_names_the_file(spark, tmp_path):
    (tmp_path / "a_2023.csv").write_text("t,v\n2024-01-01 00:00:00,1.5\n")
    (tmp_path / "b_2024.csv").write_text("t,v\n2024-01-02 00:00:00,2.5\n2024-01-03 00:00:00,\n")
    (tmp_path / "empty.csv").write_text("")
    (tmp_path / "other.txt").write_text("x\n")
    df = io.scan_folder(spark, str(tmp_path), "*.csv", "csv", schema="t string, v double", required=["t", "v"])
    assert sorted((r["file_name"], r["v"]) for r in df.collect() if r["v"]) == [("a_2023.csv", 1.5), ("b_2024.csv", 2.5)]
    years = df.select(*io.file_attributes(F.col("file_name"))).groupBy("year").count()
    assert {r["year"]: r["count"] for r in years.collect()} == {2023: 1, 2024: 2}
    one = io.read_table(spark, str(tmp_path / "a_2023.csv"), "csv", schema="t string, v double", timestamps=["t"])
    assert str(one.first()["t"]) == "2024-01-01 00:00:00"


def test_missing_columns_are_named(spark):
    with pytest.raises(io.MissingColumns, match="b, c"):
        io.require_columns(spark.range(1).withColumn("a", F.lit(1)), ["a", "b", "c"])


def test_replace_slice_leaves_other_slices(spark, tmp_path):
    path = str(tmp_path / "t")
    io.write_table(spark.createDataFrame([("a", 1), ("b", 2)], "k string, v int"), path, partition_by=["k"])
    io.replace_slice(spark.createDataFrame([("b", 7), ("b", 8)], "k string, v int"), path, ["k"])
    assert sorted((r["k"], r["v"]) for r in spark.read.parquet(path).collect()) == [("a", 1), ("b", 7), ("b", 8)]


def test_build_balance_from_cells(spark):
    head = [(2024, "TJ", 3, 1, "Coal and its processed products"), (2024, "TJ", 3, 2, None), (2024, "TJ", 3, 3, "Natural gas2"),
            (2024, "TJ", 3, 4, None), (2024, "TJ", 4, 1, "Hard coal, thousand tons"), (2024, "TJ", 4, 2, "Coke"), (2024, "TJ", 4, 3, None), (2024, "TJ", 4, 4, None)]
    body = [(2024, "TJ", 5, 0, "1. Supply"), (2024, "TJ", 6, 0, "Imports (+)"), (2024, "TJ", 6, 1, "1 234,5"), (2024, "TJ", 6, 2, "-"), (2024, "TJ", 6, 3, "7"),
            (2024, "TJ", 6, 4, "99"), (2024, "TJ", 7, 0, "1) a footnote"), (2024, "TJ", 7, 1, "5"), (2024, "TJ", 8, 0, "import"), (2024, "TJ", 8, 1, "3")]
    cells = spark.createDataFrame(head + body, "year int, unit string, row_idx int, col_idx int, cell string")
    out = balance.build_balance(cells, "year", "unit")
    got = sorted((r["section"], r["line_item"], r["fuel_group"], r["fuel"], r["value"]) for r in out["balance_long"].collect())
    # column 4 has neither a fuel nor a group start; the second import row is a copy by key
    assert got == [("1_total_supply", "Imports", "Coal and products of its processing", "Hard coal", 1234.5),
                   ("1_total_supply", "Imports", "Natural gas", "Natural gas", 7.0)]
    assert {r["key"] for r in out["metadata"].collect()} == {"n_rows", "years", "units", "built_at"}


def test_clean_series_keeps_the_first_row_per_time(spark):
    rows = [("s", "2024-01-0100:00:00", 1, 5.0), ("s", "2024-01-01 00:00:00", 2, 6.0), ("s", "bad", 3, 1.0), ("s", "2024-01-01 03:00:00", 4, 2.0),
            ("s", "2024-01-01 01:00:00", 5, None)]
    out = market.clean_series(spark.createDataFrame(rows, "k string, txt string, o int, v double"), ["k"], "txt", ["v"], "o")
    assert sorted((str(r["ts"]), r["v"]) for r in out["rows"].collect()) == [("2024-01-01 00:00:00", 5.0), ("2024-01-01 03:00:00", 2.0)]
    assert sorted(str(r["ts"]) for r in out["missing"].collect()) == ["2024-01-01 01:00:00", "2024-01-01 02:00:00"]
    r = out["report"].first()
    assert (r["n_before"], r["n_blank"], r["n_bad_time"], r["n_duplicates"], r["n_after"], r["n_missing_hours"]) == (5, 1, 1, 1, 2, 2)


def test_verdict_levels(spark):
    def verdict(*levels):
        df = spark.createDataFrame([("c", "i", s, "") for s in levels], "check_name string, item string, severity string, detail string")
        return quality.verdict(df).first()["status"]

    assert verdict("pass") == "PASS" and verdict("pass", "warn") == "PASS WITH WARNINGS" and verdict("warn", "fail") == "FAIL"


def test_acceptance_and_realism(spark):
    ok = quality.acceptance(spark.createDataFrame([(3_132_268.4,)], "v double"), F.sum("v"), 3_132_269, "total").first()
    assert ok["severity"] == "pass"
    m = spark.createDataFrame([("a", 12.0, 0.9), ("b", 250.0, 1.1)], "model string, smape_pct double, mase double")
    t = spark.createDataFrame([(0.0, 1.0), (2.0, 0.04)], "dm_stat double, p_value double")
    assert {r["item"]: r["severity"] for r in quality.metric_realism(m, t).collect()} == {"smape": "fail", "mase": "pass", "comparison": "warn"}
