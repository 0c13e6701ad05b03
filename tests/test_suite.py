"""Registered queries against their SQL texts on the smallest tables."""

import duckdb
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
import pytest

import __spark_entry__ as entry
import check
from wattframe.suite import registry

SF_DIR = "/root/testdata/sf0.001"
# fits of several models each: covered by test_learners.py and by tools/check.py
SLOW = {"m8_direct_gbt", "m9_pooled_transfer", "m10_residual_transfer", "m11_zero_shot", "m12_residual_hybrid", "m13_rolling_origin_backtest",
        "m15_tune", "m16_feature_importance", "m7_lag_gbt", "p7_train_and_evaluate", "p8_mirror_test", "p10_daily_cf_compare"}


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    c.execute("SET TimeZone='UTC'")
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return c


def test_every_sql_text_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - SLOW))
def test_query_matches_sql(spark, con, name):
    got = entry.queries()[name](spark, SF_DIR).toArrow()
    sql = entry.oracle_sql().get(name)
    if sql is None:  # values are checked by the operators' own tests; here: rows, and no number that isn't one
        assert got.num_rows > 0
        assert not any(pc.any(pc.is_nan(c)).as_py() for c in got.columns if pa.types.is_floating(c.type))
        return
    want = con.execute(sql).to_arrow_table()
    names, rows = check.table_rows(got)
    want_names, want_rows = check.table_rows(want)
    assert names == want_names
    assert rows == want_rows


def test_entry_returns_rows(spark):
    assert entry.entry(spark).count() > 0


def test_repaired_charsets_of_letters_that_mangle_into_letters(spark, tmp_path):
    texts = ["Übung", "Überaus schön", "ÜÜ", "ß—“”", "é und é", "é—", "x́ ä", "Í ä", "日本 ä", "plain", "", None, "ǖ ǖ", "Ü" * 40 + "ä"]
    pq.write_table(pa.table({"doc_id": range(len(texts)), "lang": ["de"] * 7 + ["fr"] * 7, "text": texts}), tmp_path / "documents.parquet")
    name, own = "n15_repaired_charsets", duckdb.connect()
    own.execute(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet')")
    got = entry.queries()[name](spark, str(tmp_path)).toArrow()
    assert check.table_rows(got) == check.table_rows(own.execute(entry.oracle_sql()[name]).to_arrow_table())
    assert sum(got.column("n_cp1252").to_pylist()) < sum(got.column("n_cp866").to_pylist()) < sum(got.column("n_marked").to_pylist())
