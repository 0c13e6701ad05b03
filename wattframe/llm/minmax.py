"""Near-duplicate components by min-max hashing, confirmed on full shingle sets.

Under each permutation a set keeps its smallest and its largest hash, so half as many hash evaluations fill the signature; either agrees
between two sets with a probability equal to their similarity. Bands of eight such values deal the distinct sets to buckets.
At a similarity of 0.85 two sets miss each other in all 48 bands with a probability of 2e-7, and sets that share but a
passage hardly ever meet.

Sets that share a bucket, directly or through others, are one candidate group, each set in one. Groups are checked in blocks:
intersections of all sets of a block are counted at once from its inverted lists, and a block gives no pairs but a forest of
links. Blocks of one group meet each other only in sets that aren't connected yet. No group is gathered whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.components import components
from wattframe.llm.text import LOWER, WHITESPACE, mix, segment_sums, span_hashes, text_slices, word_spans
from wattframe.session import cut_lineage

BANDS, ROWS = 48, 8
#: sizes that a block of sets keeps to on average
BLOCK_SETS, BLOCK_SHINGLES = 1024, 500_000
#: inverted lists up to this length are counted pair by pair, longer ones by matrix products
SHORT_LIST = 24

_MUL = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9], np.uint64)


def shingle_sets(data: np.ndarray, offsets: np.ndarray, width: int = 3) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hashes, splits): the sorted distinct hashes of each row's shingles of ``width`` words, one row after another.

    A row with fewer words has the whole sequence as its one shingle, a row without words an empty set.
    """
    data = LOWER[data]
    starts, ends, splits = word_spans(data, offsets, WHITESPACE)
    words = span_hashes(data, starts, ends)
    counts = np.diff(splits)
    shingle = np.zeros(len(words), np.uint64)
    for j in range(width):
        shifted = np.zeros_like(words)
        shifted[:len(words) - j] = words[j:]
        shingle += mix(shifted ^ _MUL[0]) * (_MUL[1] + np.uint64(2 * j))
    row = np.repeat(np.arange(len(counts)), counts)
    whole = np.arange(len(words)) - splits[:-1][row] <= counts[row] - width
    row, shingle = row[whole], mix(shingle[whole])
    # short rows: their words by place, and their number
    short = np.flatnonzero((counts > 0) & (counts < width))
    if len(short):
        value = np.zeros(len(short), np.uint64)
        for j in range(width - 1):
            has = counts[short] > j
            value[has] += mix(words[splits[short[has]] + j] ^ _MUL[2]) * (_MUL[1] + np.uint64(2 * j))
        row, shingle = np.concatenate([row, short]), np.concatenate([shingle, mix(value + counts[short].astype(np.uint64))])
    order = np.lexsort((shingle, row))
    row, shingle = row[order], shingle[order]
    new = np.ones(len(row), bool)
    new[1:] = (row[1:] != row[:-1]) | (shingle[1:] != shingle[:-1])
    row, shingle = row[new], shingle[new]
    return shingle, np.searchsorted(row, np.arange(len(counts) + 1))


_rng = np.random.Generator(np.random.PCG64(20240229))
_FACTORS = _rng.integers(0, 1 << 63, 4096, dtype=np.uint64) * np.uint64(2) + np.uint64(1)


def band_keys(shingles: np.ndarray, splits: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """Rows x bands: hashes of ``rows`` min-max values each, the number of the band mixed in. Empty sets get zeros."""
    keys = np.zeros((len(splits) - 1, bands), np.uint64)
    full = np.flatnonzero(np.diff(splits))
    if not len(full):
        return keys
    starts = splits[full]
    for band in range(bands):
        key = np.full(len(full), band + 1, np.uint64)
        for j in range(rows // 2):
            permuted = shingles * _FACTORS[band * (rows // 2) + j]
            permuted ^= permuted >> np.uint64(32)
            for end in (np.minimum, np.maximum):
                key = mix(key ^ end.reduceat(permuted, starts)) + np.uint64(j)
        keys[full, band] = key
    return keys


def signatures(docs: DataFrame, width: int = 3, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """doc_id, n_shingles, set_a, set_b (128 bits that stand for the set), bands of every row of ``docs`` (doc_id, text)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(1)):
                shingles, splits = shingle_sets(data, offsets, width)
                keys = band_keys(shingles, splits, bands, rows)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(0, keys.size + 1, bands, dtype=np.int32)), pa.array(keys.ravel().view(np.int64)))
                marks = [segment_sums(mix(shingles ^ f).view(np.int64), splits) for f in _FACTORS[-2:]]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first), batch.column(2).slice(first, last - first), pa.array(np.diff(splits)),
                                                  pa.array(marks[0]), pa.array(marks[1]), lists],
                                                 names=["doc_id", "text_hash", "n_shingles", "set_a", "set_b", "bands"])

    return docs.select(docs["doc_id"].cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("text_hash")).mapInArrow(
        run, "doc_id long, text_hash long, n_shingles long, set_a long, set_b long, bands array<long>")


def block_links(sets: list[np.ndarray], apart: np.ndarray | None = None, percent: int = 85) -> list[tuple[int, int]]:
    """A forest of the links 100 * intersection >= percent * union between the sets, exact.

    ``apart``: a label for each set; only sets of different labels are linked, those of one label count as connected.
    """
    n = len(sets)
    sizes = np.array([len(s) for s in sets], np.int64)
    _, shingle, counts = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    owner = np.repeat(np.arange(n), sizes)
    order = np.argsort(shingle, kind="stable")
    owner, ends = owner[order], np.cumsum(counts)
    common = np.zeros((n, n), np.float32)
    flat = common.reshape(-1)
    for length in range(2, SHORT_LIST + 1):
        lists = owner[(ends[counts == length] - length)[:, None] + np.arange(length)]
        for i in range(length):
            for j in range(i + 1, length):
                np.add.at(flat, lists[:, i] * n + lists[:, j], 1)
    long = np.flatnonzero(counts > SHORT_LIST)
    for lo in range(0, len(long), 2048):
        part = long[lo:lo + 2048]
        holds = np.zeros((len(part), n), np.float32)
        where = np.concatenate([owner[ends[k] - counts[k]:ends[k]] for k in part])
        holds[np.repeat(np.arange(len(part)), counts[part]), where] = 1
        common += np.triu(holds.T @ holds, 1)
    both = common.astype(np.int64)
    linked = (100 + percent) * both >= percent * (sizes[:, None] + sizes[None, :])
    linked &= both > 0
    label = np.arange(n) if apart is None else np.unique(apart, return_inverse=True)[1]
    root = np.arange(max(n, int(label.max(initial=0)) + 1))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for a, b in np.argwhere(linked & (label[:, None] != label[None, :])).tolist():
        x, y = find(label[a]), find(label[b])
        if x != y:
            root[x] = y
            out.append((a, b))
    return out


def _links(sets: DataFrame, keys: list[str], percent: int) -> DataFrame:
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        node = rows.node.to_numpy()
        apart = rows.label.to_numpy() if "label" in rows else None
        if apart is not None and len(np.unique(apart)) < 2:
            return pd.DataFrame({"a": np.zeros(0, np.int64), "b": np.zeros(0, np.int64)})
        found = block_links([np.frombuffer(x, np.uint64) for x in rows.shingles], apart, percent)
        pairs = np.array(found, np.int64).reshape(-1, 2)
        return pd.DataFrame({"a": node[pairs[:, 0]], "b": node[pairs[:, 1]]})

    return sets.groupBy(*keys).applyInPandas(run, "a long, b long")


def _full_sets(docs: DataFrame, wanted: DataFrame, width: int) -> DataFrame:
    """The columns of ``wanted`` but its doc_id and text_hash, and shingles: the set of one row of ``docs`` for each."""
    made = docs.select(docs["doc_id"].cast("long").alias("doc_id"), F.xxhash64("text").alias("text_hash"), "text")
    found = made.join(wanted.withColumnRenamed("doc_id", "__d"), (F.col("doc_id").eqNullSafe(F.col("__d"))) & (made["text_hash"] == wanted["text_hash"]))
    rows = found.drop(wanted["text_hash"]).drop("doc_id", "text_hash", "__d")
    others = [c for c in rows.columns if c != "text"]
    rows = rows.select(*others, "text")
    shape = rows.drop("text").selectExpr("*", "CAST(NULL AS BINARY) AS shingles").schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first, last, data, offsets in text_slices(batch.column(len(others))):
                shingles, splits = shingle_sets(data, offsets, width)
                sets = pa.array([shingles[a:b].tobytes() for a, b in zip(splits[:-1], splits[1:], strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([*(c.slice(first, last - first) for c in batch.columns[:-1]), sets], names=[*others, "shingles"])

    return rows.mapInArrow(run, shape)


def band_links(nodes: DataFrame) -> DataFrame:
    """a, b: each set of ``nodes`` (node, bands) with the first set of each of its band keys, but for that set itself.

    The first sets are an aggregate and are saved, so the join deals both sides anew and can split a frequent key.
    """
    met = nodes.select("node", F.explode("bands").alias("key"))
    shared = met.groupBy("key").agg(F.min("node").alias("a"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", "a")
    return met.join(cut_lineage(shared), "key").where("a <> node").select("a", F.col("node").alias("b"))


def _labeled(docs: DataFrame, width: int, percent: int) -> tuple[DataFrame, DataFrame]:
    """The rows of signatures() with a row id, and row, doc_id, text_hash, n_shingles, label of those with words: one label a component."""
    rows = signatures(docs, width)
    rows = cut_lineage(rows.withColumn("row", F.monotonically_increasing_id()))  # row ids must not change when a task runs again
    full = rows.where("n_shingles > 0")
    sets = full.groupBy("set_a", "set_b").agg(F.min("row").alias("node"))
    nodes = full.join(sets.select(F.col("node").alias("row")), "row")
    groups = components(band_links(nodes.select(F.col("row").alias("node"), "bands")))

    member = groups.join(full.select(F.col("row").alias("node"), "doc_id", "text_hash", "n_shingles"), "node")
    sizes = member.groupBy("label").agg(F.count(F.lit(1)).alias("n"), F.sum("n_shingles").alias("words"))
    blocks = F.greatest(F.ceil(F.col("n") / BLOCK_SETS), F.ceil(F.col("words") / BLOCK_SHINGLES)).cast("long")
    sizes = cut_lineage(sizes.select(F.col("label").alias("group"), blocks.alias("blocks"), "n", "words"))  # one row per group
    total = sizes.where("blocks = 1").agg(F.sum("n").alias("n"), F.sum("words").alias("words")).first()
    bins = max(1, -(-(total.n or 0) // BLOCK_SETS), -(-(total.words or 0) // BLOCK_SHINGLES))
    placed = member.withColumnRenamed("label", "group").join(sizes.select("group", "blocks"), "group")
    # small groups share a block, a large one has blocks of its own
    block = F.when(F.col("blocks") == 1, F.expr(f"pmod(xxhash64(group), {bins})")).otherwise(F.expr("pmod(xxhash64(node), blocks)"))
    home = F.when(F.col("blocks") == 1, F.lit(-1)).otherwise(F.col("group"))
    placed = placed.select("doc_id", "text_hash", "node", home.alias("home"), block.cast("long").alias("block"), "blocks")
    shingles = _full_sets(docs, placed, width).dropDuplicates(["node"])
    large = not sizes.where("blocks > 1").isEmpty()
    if large:
        shingles = cut_lineage(shingles)
    links = cut_lineage(_links(shingles, ["home", "block"], percent))
    if large:
        own = components(links)
        split = shingles.where("blocks > 1").join(own, "node", "left").withColumn("label", F.coalesce("label", "node"))
        split = split.withColumn("other", F.explode(F.filter(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda k: k != F.col("block"))))
        split = split.select("node", "label", "home", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "shingles")
        links = links.union(_links(split, ["home", "low", "high"], percent))
    merged = components(links)

    named = sets.join(merged, "node", "left").select("set_a", "set_b", F.coalesce("label", "node").alias("label"))
    labeled = full.join(named, ["set_a", "set_b"]).select("row", "doc_id", "text_hash", "n_shingles", "label")
    return rows, labeled


def near_duplicates(docs: DataFrame, *, width: int = 3, percent: int = 85) -> DataFrame:
    """doc_id, text_hash, n_shingles, component_id, kept of every row of ``docs`` (doc_id, text).

    Rows are linked when 100 * intersection >= ``percent`` * union of their shingle sets; component_id is the smallest doc_id that
    links lead to, kept says that the row bears it. A row without words (null or empty text) is linked with nothing. Repeated
    rows have equal sets and share a component. A null doc_id stays null, never gives its component the name and isn't kept.
    An empty table gives no rows; other columns are left out.
    """
    rows, labeled = _labeled(docs, width, percent)
    least = labeled.groupBy("label").agg(F.min("doc_id").alias("component_id"))
    found = labeled.join(least, "label").select("doc_id", "text_hash", "n_shingles", "component_id")
    alone = rows.where("n_shingles = 0").select("doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"))
    return found.union(alone).withColumn("kept", F.coalesce(F.col("doc_id") == F.col("component_id"), F.lit(False)))


def one_of_each(docs: DataFrame, *, width: int = 3, percent: int = 85) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) that stay: one of each component, and all rows without words.

    It is the row with the smallest doc_id, null last, and of those the one with the smallest hash of its text; of rows that agree in
    both, which have equal texts, any one.
    """
    _, labeled = _labeled(docs, width, percent)
    labeled = cut_lineage(labeled.select("label", F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce("doc_id", F.lit(0)).alias("doc_id"), "text_hash").alias("name")))
    least = labeled.groupBy("label").agg(F.min("name").alias("least"))
    gone = labeled.join(least, "label").where(F.col("name") != F.col("least")).select("name").distinct()
    again = labeled.groupBy("name").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("name")
    name = F.struct(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("long"), F.lit(0)).alias("doc_id"), F.xxhash64("text").alias("text_hash"))
    stay = docs.withColumn("__name", name).join(gone.withColumnRenamed("name", "__gone"), F.col("__name") == F.col("__gone"), "left_anti")
    if again.isEmpty():
        return stay.select(*docs.columns)
    again = cut_lineage(again.withColumnRenamed("name", "__again"))
    twice = stay.join(again, F.col("__name") == F.col("__again"), "left_semi").dropDuplicates(["__name"])
    return stay.join(again, F.col("__name") == F.col("__again"), "left_anti").union(twice).select(*docs.columns)
