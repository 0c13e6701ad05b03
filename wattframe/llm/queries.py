"""Registered queries of the subpackage: each operator over its whole table, and the SQL texts where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from wattframe.llm import mixing
from wattframe.llm.cuckoo import exact_dedup
from wattframe.llm.filteraudit import filter_audit
from wattframe.llm.kdshards import kd_shards
from wattframe.llm.kneserney import quality
from wattframe.llm.langid import identify
from wattframe.llm.merkle import manifest
from wattframe.llm.minmax import near_duplicates
from wattframe.llm.packing import pack
from wattframe.llm.pitmanyor import scores
from wattframe.llm.tokens import token_counts
from wattframe.llm.topk import top_products
from wattframe.llm.toxicity import toxicity

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_square_sum_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(documents(spark, sf_dir))


def op2_cuckoo_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup(documents(spark, sf_dir)).drop("row_id")


ORACLES["op2_cuckoo_dedup"] = """
WITH t AS (SELECT doc_id, translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents)
SELECT doc_id, MAX(doc_id) OVER w AS keep_id, COUNT(*) OVER w AS group_size, doc_id = MAX(doc_id) OVER w AS kept, sha256(text) AS text_sha256
FROM t WINDOW w AS (PARTITION BY text)
"""


def op3_minmax_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(documents(spark, sf_dir)).drop("text_hash")


ORACLES["op3_minmax_components"] = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(COALESCE(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, CASE WHEN len(w) < 3 THEN array_to_string(w, ' ') ELSE array_to_string(w[i:i + 2], ' ') END AS s
  FROM words, UNNEST(range(1, GREATEST(len(w) - 1, 2))) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT doc_id, COUNT(*) AS n FROM shingles GROUP BY doc_id),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b, COUNT(*) AS common FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
links AS (
  SELECT a, b FROM pairs JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 85 * (x.n + y.n - common)),
either_way AS (SELECT a, b FROM links UNION ALL SELECT b, a FROM links),
reach AS (SELECT DISTINCT a AS doc_id, a AS other FROM either_way UNION SELECT r.doc_id, e.b FROM reach r JOIN either_way e ON r.other = e.a),
least AS (SELECT doc_id, MIN(other) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, COALESCE(n, 0) AS n_shingles, COALESCE(component_id, d.doc_id) AS component_id, COALESCE(component_id, d.doc_id) = d.doc_id AS kept
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id LEFT JOIN least l ON l.doc_id = d.doc_id
"""


def op4_segment_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = spark.read.parquet(f"{sf_dir}/embeddings.parquet")
    return top_products(vectors, vectors["vec_id"] % 20 == 0)


ORACLES["op4_segment_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: FLOOR(64 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
scored AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e::DOUBLE[], c.e::DOUBLE[])::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id % 20 = 0 AND c.vec_id <> q.vec_id)
SELECT query_id, ROW_NUMBER() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank, vec_id, score FROM scored
QUALIFY rank <= 20
"""


def op5_threshold_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(documents(spark, sf_dir))


ORACLES["op5_threshold_mixing"] = mixing.ORACLE_SQL


def op6_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality = 1"))


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(documents(spark, sf_dir))


def op8_convolution_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


def op9_kd_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kd_shards(documents(spark, sf_dir), shards=24)


def op10_viterbi_languages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify(documents(spark, sf_dir))


def op11_posting_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"))


ORACLES["op11_posting_audit"] = r"""
WITH words AS (
  SELECT doc_id, COALESCE(lang, '') AS part, COALESCE(text, '') AS text, regexp_extract_all(COALESCE(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
marks AS (SELECT doc_id, BOOL_OR(quality = 1) AS good, BOOL_OR(toxic = 1) AS toxic FROM labels GROUP BY doc_id),
fails AS (
  SELECT part, COALESCE(good, FALSE) AS good, COALESCE(toxic, FALSE) AS toxic,
    (len(w) < 100)::INT + 2 * (100 * len(list_distinct(w)) < 80 * len(w))::INT
    + 4 * (100 * length(regexp_replace(text, '[^A-Z]', '', 'g')) > 10 * length(text))::INT + 8 * regexp_matches(text, '[#$%&*|]')::INT
    + 16 * COALESCE(words.doc_id > MIN(words.doc_id) OVER (PARTITION BY text), FALSE)::INT AS mask
  FROM words LEFT JOIN marks USING (doc_id)),
counts AS (SELECT part, mask, COUNT(*) AS n, COUNT(*) FILTER (good) AS good, COUNT(*) FILTER (toxic) AS toxic FROM fails GROUP BY part, mask),
f AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS f),
orders AS (
  SELECT a.f || b.f || c.f || d.f || e.f AS filter_order FROM f a, f b, f c, f d, f e
  WHERE len(list_distinct([a.f, b.f, c.f, d.f, e.f])) = 5),
steps AS (
  SELECT filter_order, step::INT AS step, 1 << (ascii(filter_order[step]) - 65) AS own,
    COALESCE(list_sum(list_transform(range(1, step), lambda k: 1 << (ascii(filter_order[k]) - 65))), 0)::INT AS before
  FROM orders, range(1, 6) AS r(step)),
audit AS (
  SELECT part, filter_order, step, own, COALESCE(SUM(n) FILTER (mask & (before | own) = 0), 0)::BIGINT AS kept,
    COALESCE(SUM(n) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS removed,
    COALESCE(SUM(n) FILTER (mask & before > 0 AND mask & own > 0), 0)::BIGINT AS redundant, COALESCE(SUM(n) FILTER (mask = own), 0)::BIGINT AS unique_fails,
    COALESCE(SUM(good) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS good_lost,
    COALESCE(SUM(toxic) FILTER (mask & before = 0 AND mask & own > 0), 0)::BIGINT AS toxic_lost
  FROM counts, steps GROUP BY part, filter_order, step, own)
SELECT part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, (SUM(removed) OVER (PARTITION BY part, own))::BIGINT AS shapley
FROM audit
"""


def op12_pitman_yor_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scores(documents(spark, sf_dir))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return manifest(documents(spark, sf_dir))


ORACLES["op13_merkle_manifest"] = r"""
WITH RECURSIVE fields AS (
  SELECT doc_id, lang, n_chars, [doc_id::VARCHAR, source, lang] AS before, text, doc_id::VARCHAR AS id FROM documents),
coded AS (
  SELECT doc_id, lang, list_reduce(list_prepend('', list_transform(before, lambda v: COALESCE(strlen(v) || ':' || v, '-'))), lambda a, b: a || b) AS head,
    n_chars, COALESCE(strlen(text) || ':' || text, '-') AS tail,
    xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(range(1, len(id) + 1), lambda i: ascii(id[i])::BIGINT)),
      lambda acc, b: list_reduce(list_prepend(xor(acc, b), range(8)), lambda r, k: xor(r >> 1, 3988292384 * (r & 1))))) AS crc
  FROM fields),
leaves AS (
  SELECT *, ROW_NUMBER() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, h) - 1 AS pos, COUNT(*) OVER (PARTITION BY lang) AS n, ROW_NUMBER() OVER () AS row
  FROM (SELECT doc_id, lang, sha256(head || COALESCE(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') || tail) AS h,
    sha256(head || COALESCE(strlen((n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END)::VARCHAR) || ':' || (n_chars + CASE WHEN crc % 7 = 0 THEN 1 ELSE 0 END), '-') || tail) AS t
    FROM coded)),
inner_nodes AS (
  SELECT lang, 0 AS lvl, pos, h, n FROM leaves
  UNION ALL SELECT lang, lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM inner_nodes WHERE n > 1 GROUP BY lang, lvl, n, pos // 2),
tops AS (SELECT lang, h, ROW_NUMBER() OVER (ORDER BY lang NULLS FIRST) - 1 AS pos, COUNT(*) OVER () AS n FROM inner_nodes WHERE n = 1),
outer_nodes AS (
  SELECT 0 AS lvl, pos, h, n FROM tops
  UNION ALL SELECT lvl + 1, pos // 2, sha256(string_agg(h, '' ORDER BY pos)), (n + 1) // 2 FROM outer_nodes WHERE n > 1 GROUP BY lvl, n, pos // 2),
steps AS (
  SELECT row, x.lvl, (l.pos >> x.lvl) & 1 AS side, s.h AS sibling
  FROM leaves l JOIN inner_nodes x ON l.lang IS NOT DISTINCT FROM x.lang AND x.pos = l.pos >> x.lvl AND x.n > 1
    LEFT JOIN inner_nodes s ON s.lang IS NOT DISTINCT FROM x.lang AND s.lvl = x.lvl AND s.pos = xor(x.pos, 1)
  UNION ALL
  SELECT row, 1000 + x.lvl, (o.pos >> x.lvl) & 1, s.h
  FROM leaves l JOIN tops o ON l.lang IS NOT DISTINCT FROM o.lang JOIN outer_nodes x ON x.pos = o.pos >> x.lvl AND x.n > 1
    LEFT JOIN outer_nodes s ON s.lvl = x.lvl AND s.pos = xor(x.pos, 1)),
paths AS (
  SELECT row, list(CASE WHEN sibling IS NULL THEN '-' WHEN side = 1 THEN 'R' || sibling ELSE 'L' || sibling END ORDER BY lvl) AS path,
    string_agg(sibling, '' ORDER BY lvl) AS siblings FROM steps GROUP BY row),
folded AS (
  SELECT doc_id, l.h AS leaf, o.h AS subroot, (SELECT h FROM outer_nodes WHERE n = 1) AS root, sha256(COALESCE(siblings, '')) AS proof_sha256,
    list_reduce(list_prepend(t, COALESCE(path, [])),
      lambda acc, s: CASE WHEN s = '-' THEN sha256(acc) WHEN s[1] = 'R' THEN sha256(s[2:] || acc) ELSE sha256(acc || s[2:]) END) AS folded_root
  FROM leaves l JOIN tops o ON l.lang IS NOT DISTINCT FROM o.lang LEFT JOIN paths USING (row))
SELECT *, folded_root = root AS verified FROM folded
"""


for _query in (op1_square_sum_packing, op2_cuckoo_dedup, op3_minmax_components, op4_segment_topk, op5_threshold_mixing, op6_kneser_ney_quality, op7_token_counts, op8_convolution_toxicity, op9_kd_shards, op10_viterbi_languages,
               op11_posting_audit, op12_pitman_yor_scores, op13_merkle_manifest):
    QUERIES[_query.__name__] = _query
