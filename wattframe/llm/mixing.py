"""Mixing of sources to target weights by nested hash-threshold histograms, in DataFrame operations alone.

Every document has a fixed hash. A source takes each of its documents a whole number of times, and once more those whose hash
lies under the source's threshold. The threshold comes from word sums by source and hash bucket: the bucket in which the budget
ends is found and only its documents are summed again by finer buckets. Nothing is sorted but histograms, and thresholds are
nested: a larger budget takes all that a smaller one takes.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.session import cut_lineage

WEIGHTS = (5, 2, 1)
MOST = 3
#: bits of a histogram and how many are nested: a bucket of the last holds 2**-30 of a source, about one document of a billion
BITS, LEVELS = 10, 3
#: tables with one row per source are broadcast up to so many, else joined by a shuffle
BROADCAST_SOURCES = 100_000


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def hash_bucket(doc_id: Column) -> Column:
    """The first 30 of a document's hash bits, from the MD5 of its id as text (null: of nothing)."""
    return F.shiftright(F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long"),
                        60 - BITS * LEVELS)


def source_targets(sources: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size -> also target: shares by weight of all words, none above ``most`` times its source's size.

    Sources stand in the order of their code points, null last, and the weights repeat. What is above a bound is shared again by
    weight; the end of that is target = min(most * size, level * weight), and the level is found in one pass over the sources
    in the order of bound / weight.
    """
    everywhere = Window.partitionBy()
    ranked = sources.withColumn("_rank", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("_rank") - 1) % len(weights) + 1)
    ranked = ranked.withColumn("_w", weight).withColumn("_cap", F.col("source_size") * F.lit(float(most)))
    before = Window.orderBy(F.col("_cap") / F.col("_w"), "_rank").rowsBetween(Window.unboundedPreceding, -1)
    ranked = ranked.withColumns({
        "_all": F.sum("source_size").over(everywhere).cast("double"), "_w_all": F.sum("_w").over(everywhere),
        "_cap_before": F.coalesce(F.sum("_cap").over(before), F.lit(0.0)), "_w_before": F.coalesce(F.sum("_w").over(before), F.lit(0.0)),
    })
    capped = F.col("_cap_before") + F.col("_cap") / F.col("_w") * (F.col("_w_all") - F.col("_w_before")) < F.col("_all")
    ranked = ranked.withColumns({"_capped": capped})
    level = ((F.col("_all") - F.sum(F.when(F.col("_capped"), F.col("_cap")).otherwise(0.0)).over(everywhere))
             / F.nullif(F.col("_w_all") - F.sum(F.when(F.col("_capped"), F.col("_w")).otherwise(0.0)).over(everywhere), F.lit(0.0)))
    ranked = ranked.withColumn("target", F.least("_cap", F.coalesce(level, F.lit(0.0)) * F.col("_w")))
    return ranked.select("source", "source_size", "target")


def thresholds(sizes: DataFrame, budgets: DataFrame, few: bool = False) -> DataFrame:
    """source, limit: the documents of a source whose bucket lies under the limit hold about ``budget`` words.

    ``sizes`` has source, size and bucket, ``budgets`` source and budget (below the source's size, else no row comes back). ``few``
    says that there are at most BROADCAST_SOURCES of them.
    """
    found, rest = budgets.select("source", "budget", F.lit(0).cast("long").alias("prefix")), sizes
    for level in range(1, LEVELS + 1):
        prefix = F.shiftright("bucket", BITS * (LEVELS - level))
        if level > 1:  # only documents of the boundary bucket go on
            edge = found.select(F.col("source").alias("_s"), F.col("prefix").alias("_p"))
            rest = rest.join(F.broadcast(edge) if few else edge, F.col("source").eqNullSafe(F.col("_s")) & (F.shiftright("bucket", BITS * (LEVELS - level + 1)) == F.col("_p"))).drop("_s", "_p")
        sums = rest.groupBy("source", prefix.alias("_b")).agg(F.sum("size").alias("_words"))
        upto = Window.partitionBy("source").orderBy("_b")
        sums = sums.withColumn("_upto", F.sum("_words").over(upto)).withColumnRenamed("source", "_s")
        hit = found.join(sums, F.col("source").eqNullSafe(F.col("_s")) & (F.col("_upto") > F.col("budget")) & (F.col("_upto") - F.col("_words") <= F.col("budget")))
        before = F.col("_upto") - F.col("_words")
        if level == LEVELS:  # the last bucket goes to the side that is nearer
            nearer = F.col("_upto") - F.col("budget") < F.col("budget") - before
            return hit.select("source", (F.col("_b") + nearer.cast("long")).alias("limit"))
        found = hit.select("source", (F.col("budget") - before).alias("budget"), F.col("_b").alias("prefix"))
    raise AssertionError("no level")


def source_plan(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """source, source_size, target, whole, limit: each document comes ``whole`` times, and once more if its bucket lies under ``limit``."""
    targets = source_targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, most)
    rate = F.col("target") / F.nullif(F.col("source_size").cast("double"), F.lit(0.0))
    targets = cut_lineage(targets.withColumn("whole", F.coalesce(F.floor(rate), F.lit(0)).cast("long")))  # one row per source
    few = targets.count() <= BROADCAST_SOURCES
    budgets = targets.select("source", (F.col("target") - F.col("whole") * F.col("source_size")).alias("budget"))
    limits = thresholds(sizes, budgets, few).withColumnRenamed("source", "_s")
    return cut_lineage(targets.join(limits, F.col("source").eqNullSafe(F.col("_s")), "left").drop("_s"))


def with_copies(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Adds __source_size, __target and __copies to ``rows`` (source, __bucket)."""
    copies = F.col("__whole") + F.coalesce((F.col("__bucket") < F.col("__limit")).cast("long"), F.lit(0))
    named = plan.select([plan[c].alias(f"__{c}") for c in plan.columns])
    if plan.count() <= BROADCAST_SOURCES:
        named = F.broadcast(named)
    return rows.join(named, F.col("source").eqNullSafe(F.col("__source"))).withColumn("__copies", copies).drop("__source", "__whole", "__limit")


def document_sizes(docs: DataFrame) -> DataFrame:
    return cut_lineage(docs.select(docs["doc_id"], docs["source"], word_count(docs["text"]).alias("size"), hash_bucket(docs["doc_id"]).alias("bucket")))


def mix(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """doc_id, source, size, source_size, target, copies, taken for every row of ``docs`` (doc_id, text, source).

    A null or empty text has size 0 and takes 0 words; a null source is a source of its own, the last; repeated rows of one doc_id
    share their fate. copies times size is taken, and no document comes more than ``most`` times. An empty table gives no rows.
    """
    sizes = document_sizes(docs)
    out = with_copies(sizes.withColumnRenamed("bucket", "__bucket"), source_plan(sizes, weights, most))
    return out.select("doc_id", "source", "size", F.col("__source_size").alias("source_size"), F.col("__target").alias("target"),
                      F.col("__copies").alias("copies"), (F.col("__copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, *, weights: tuple[int, ...] = WEIGHTS, most: int = MOST) -> DataFrame:
    """The rows of ``docs``, each as often as the mix takes it: the texts stay where they are, only the plan by source goes to them."""
    plan = source_plan(document_sizes(docs), weights, most)
    rows = with_copies(docs.withColumn("__bucket", hash_bucket(docs["doc_id"])), plan)
    return rows.where("__copies > 0").withColumn("__copy", F.explode(F.sequence(F.lit(1).cast("long"), "__copies"))).select(*docs.columns)


ORACLE_SQL = r"""
WITH sizes AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(COALESCE(doc_id::VARCHAR, '')), 1, 15))::BIGINT >> 30 AS bucket
  FROM documents),
sources AS (SELECT source, SUM(size)::BIGINT AS source_size, ROW_NUMBER() OVER (ORDER BY source NULLS LAST) AS r FROM sizes GROUP BY source),
weighed AS (SELECT *, CASE (r - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w, source_size * 3.0::DOUBLE AS cap FROM sources),
ordered AS (
  SELECT *, COALESCE(SUM(cap) OVER o, 0) AS cap_before, COALESCE(SUM(w) OVER o, 0) AS w_before,
         (SUM(source_size) OVER ())::DOUBLE AS total, SUM(w) OVER () AS w_all
  FROM weighed WINDOW o AS (ORDER BY cap / w, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
capped AS (SELECT *, cap_before + cap / w * (w_all - w_before) < total AS is_capped FROM ordered),
leveled AS (
  SELECT *, (total - SUM(CASE WHEN is_capped THEN cap ELSE 0.0::DOUBLE END) OVER ())
            / NULLIF(w_all - SUM(CASE WHEN is_capped THEN w ELSE 0.0::DOUBLE END) OVER (), 0) AS lvl FROM capped),
targets AS (SELECT source, source_size, LEAST(cap, COALESCE(lvl, 0) * w) AS target FROM leveled),
plan AS (SELECT *, COALESCE(FLOOR(target / NULLIF(source_size::DOUBLE, 0)), 0)::BIGINT AS whole FROM targets),
buckets AS (SELECT source, bucket, SUM(size)::BIGINT AS words FROM sizes GROUP BY source, bucket),
running AS (SELECT *, (SUM(words) OVER (PARTITION BY source ORDER BY bucket))::BIGINT AS upto FROM buckets),
limits AS (
  SELECT p.source, r.bucket + CASE WHEN r.upto - b < b - (r.upto - r.words) THEN 1 ELSE 0 END AS lim
  FROM (SELECT *, target - whole * source_size AS b FROM plan) p
  JOIN running r ON r.source IS NOT DISTINCT FROM p.source AND r.upto > b AND r.upto - r.words <= b)
SELECT s.doc_id, s.source, s.size, p.source_size, p.target, p.whole + CASE WHEN s.bucket < l.lim THEN 1 ELSE 0 END AS copies,
       (p.whole + CASE WHEN s.bucket < l.lim THEN 1 ELSE 0 END) * s.size AS taken
FROM sizes s JOIN plan p ON s.source IS NOT DISTINCT FROM p.source LEFT JOIN limits l ON l.source IS NOT DISTINCT FROM p.source
"""
