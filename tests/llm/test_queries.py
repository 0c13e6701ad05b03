"""Registered queries against their SQL texts, and the pipeline against a plain version, on the smallest tables."""

import hashlib
import re
from collections import Counter, defaultdict

import duckdb
import pytest

import __spark_entry__ as entry
import check
import corpus_pipeline
from test_dedup_mixing import lowered, targets
from test_near_topk import brute
from test_tokens_packing import library_ids
from wattframe.llm.queries import ORACLES, QUERIES

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in check.TABLES:
        c.execute(f"create view {t} as select * from read_parquet('{SF_DIR}/{t}.parquet')")
    return c


def test_all_queries_are_registered():
    assert {int(re.match(r"op(\d+)_", n)[1]) for n in QUERIES} == set(range(1, 14)) and len(QUERIES) == 13
    assert set(QUERIES) | {"pipeline"} <= set(entry.queries()) and set(ORACLES) <= set(entry.oracle_sql())


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_matches_sql(spark, con, name):
    assert check.table_rows(QUERIES[name](spark, SF_DIR).toArrow()) == check.table_rows(con.sql(ORACLES[name]).to_arrow_table())


def test_pipeline_equals_a_plain_version(spark):
    docs = spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()
    docs = [d for d in docs if d.text and any(c.isalpha() for c in d.text)]
    last = {}
    for d in docs:
        key = lowered(d.text)
        if key not in last or d.doc_id > last[key].doc_id:
            last[key] = d
    docs = sorted(last.values(), key=lambda d: d.doc_id)
    roots, _ = brute([d.text for d in docs])
    docs = [d for k, d in enumerate(docs) if roots[k] == k]
    sizes, words = defaultdict(int), {d.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", d.text)) for d in docs}
    for d in docs:
        sizes[d.source] += words[d.doc_id]
    want, copies = targets(sizes), Counter()
    for source, target in want.items():
        whole = int(target // sizes[source])
        own = sorted((int(hashlib.md5(str(d.doc_id).encode()).hexdigest()[:15], 16) >> 30, d.doc_id) for d in docs if d.source == source)
        left = target - whole * sizes[source]
        for _, k in own:
            copies[k] += whole
        for _, k in own:
            if left < words[k]:
                copies[k] += words[k] - left < left
                break
            copies[k] += 1
            left -= words[k]
    tokens = {d.doc_id: len(i) + 1 for d, i in zip(docs, library_ids([d.text for d in docs]), strict=True)}
    pieces = corpus_pipeline.run(spark, SF_DIR).collect()
    got = Counter()
    for p in pieces:
        got[p.doc_id] += p.length
        assert p.doc_tokens == tokens[p.doc_id]
    assert got == Counter({k: n * tokens[k] for k, n in copies.items() if n})
    assert max(Counter((p.doc_id, p.start, p.length) for p in pieces).values()) <= 3


def test_language_stage_keeps_texts_where_no_language_is_known(spark):
    rows = [(1, "some words here"), (2, "日本語"), (3, "12 34 !!"), (4, None), (5, ""), (6, "— …"), (7, "1 é")]
    docs = spark.createDataFrame([(*r, None) for r in rows], "doc_id long, text string, lang string")
    assert sorted(r.doc_id for r in corpus_pipeline.language_id(spark, docs, SF_DIR).collect()) == [1, 2, 7]


@pytest.mark.parametrize("name,stage", corpus_pipeline.STAGES)
def test_stages_take_awkward_and_empty_tables(spark, awkward, nothing, name, stage):
    docs = awkward.select("doc_id", "text", "lang", "source", "n_chars", "score", "bucket", "copies")
    assert stage(spark, docs, SF_DIR).count() > 0
    assert name == "pack" or stage(spark, docs, SF_DIR).columns == docs.columns
    assert stage(spark, docs.limit(0), SF_DIR).count() == 0
