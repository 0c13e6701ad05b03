"""A Merkle manifest of a table: one tree for each lang, one over the trees' roots, stored in blocks of van Emde Boas layout.

Leaves are numbered in their order within a tree. Aligned runs of 2**HEIGHT leaves are blocks; each is built by one task into an array
whose subtrees are laid recursively, split at half their height, so that any path stays in few stretches of memory whatever their size.
A block's root is a leaf of the next level, so levels recurse over block roots until each tree has one. Proofs are read from the stored
blocks by address arithmetic, from the top down: a block gets the path above its root, which holds for all of its leaves.
"""

from __future__ import annotations

import hashlib
import uuid
from functools import cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.session import checkpoint_folder, cut_lineage

#: levels of a block above its leaves, 2**HEIGHT of them
HEIGHT = 12
DIGEST = 32


def serialised(value: Column) -> Column:
    """'-' for a null, else the value's length in bytes, ':' and the value."""
    text = value.cast("string")
    return F.coalesce(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def leaf_digests(docs: DataFrame) -> DataFrame:
    """row, doc_id, lang, digest, tampered: the SHA-256 of every row, and that with n_chars raised by one where its id is chosen for it."""
    fields = lambda n_chars: F.unhex(F.sha2(F.concat(*[serialised(c) for c in (docs["doc_id"], docs["source"], docs["lang"], n_chars, docs["text"])]).cast("binary"), 256))
    chosen = F.crc32(docs["doc_id"].cast("string").cast("binary")) % 7 == 0
    own = fields(docs["n_chars"])
    other = F.when(chosen & docs["n_chars"].isNotNull(), fields(docs["n_chars"] + 1))
    return docs.select(F.monotonically_increasing_id().alias("row"), docs["doc_id"], docs["lang"], own.alias("digest"), other.alias("tampered"))


def numbered(rows: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``rows`` with pos, the place within ``tree`` by ``order`` from 0, and n, the tree's rows; nulls first. ``order`` must tell all rows apart.

    Rows are dealt by ranges of (tree, order), so a large tree takes many tasks; only a count for each range and tree is added up.
    """
    keys = [tree, *order]
    dealt = cut_lineage(rows.repartitionByRange(*keys).sortWithinPartitions(*keys).select("*", F.spark_partition_id().alias("_range"), F.monotonically_increasing_id().alias("_at")))
    counts = dealt.groupBy(F.col(tree).alias("_tree"), F.col("_range").alias("_r")).agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    own = Window.partitionBy("_tree")
    counts = counts.select("_tree", "_r", (F.sum("_n").over(own.orderBy("_r")) - F.col("_n") - F.col("_first")).alias("_shift"), F.sum("_n").over(own).alias("n"))
    met = dealt.join(counts, F.col(tree).eqNullSafe(F.col("_tree")) & (F.col("_range") == F.col("_r")))
    return met.withColumn("pos", F.col("_at") + F.col("_shift")).drop("_tree", "_range", "_r", "_at", "_shift")


def address(height: int, depth: int, index: np.ndarray) -> np.ndarray:
    """Where the nodes ``index`` at ``depth`` of a perfect tree of ``height`` levels lie: the top half's tree first, then those below it."""
    base = np.zeros_like(index)
    while height > 1:
        top = height // 2
        if depth < top:
            height = top
            continue
        below, depth, height = depth - top, depth - top, height - top
        base += (1 << top) - 1 + (index >> below) * ((1 << height) - 1)
        index = index & ((1 << below) - 1)
    return base


@cache
def layout(height: int) -> list[np.ndarray]:
    """For each depth of a tree of ``height`` levels the addresses of its nodes from left to right."""
    return [address(height, depth, np.arange(1 << depth)) for depth in range(height)]


def joined(*digests: bytes) -> bytes:
    return hashlib.sha256("".join(d.hex() for d in digests).encode()).digest()


def levels_above(n: int, stage: int, most: int) -> int:
    """Levels that a block of ``stage`` has above its leaves in a tree of ``n`` leaves: as many as are left to the root, ``most`` at most."""
    return max(0, min(most, (n - 1).bit_length() - most * stage))


def build(leaves: list[bytes], height: int) -> bytes:
    """The array of a block over ``leaves`` with ``height`` levels above them. Where the leaves end early the nodes to their right stay empty."""
    places = layout(height + 1)
    nodes = np.zeros(((1 << (height + 1)) - 1, DIGEST), np.uint8)
    row = leaves
    for depth in range(height, -1, -1):
        nodes[places[depth][:len(row)]] = np.frombuffer(b"".join(row), np.uint8).reshape(-1, DIGEST)
        row = [joined(*row[k:k + 2]) for k in range(0, len(row), 2)]
    return nodes.tobytes()


def path(nodes: bytes, leaves: int, height: int, place: int) -> list[tuple[bool, bytes | None]]:
    """From leaf ``place`` up to the block's root: whether the node is the right one of its pair, and its sibling, None where it has none."""
    places, steps = layout(height + 1), []
    for depth in range(height, 0, -1):
        sibling = place ^ 1
        at = int(places[depth][sibling]) * DIGEST
        steps.append((place & 1 == 1, nodes[at:at + DIGEST] if sibling < leaves else None))
        place, leaves = place >> 1, (leaves + 1) >> 1
    return steps


def fold(digest: bytes, steps) -> bytes:
    """The root that a leaf and the siblings on its path give."""
    for right, sibling in steps:
        digest = joined(digest) if sibling is None else joined(sibling, digest) if right else joined(digest, sibling)
    return digest


def packed(steps) -> bytes:
    """A path as bytes: for each step L or R and the sibling, or - where there is none."""
    return b"".join(b"-" if sibling is None else (b"R" if right else b"L") + sibling for right, sibling in steps)


def unpacked(data: bytes) -> list[tuple[bool, bytes | None]]:
    steps, at = [], 0
    while at < len(data):
        alone = data[at:at + 1] == b"-"
        steps.append((data[at:at + 1] == b"R", None if alone else data[at + 1:at + 1 + DIGEST]))
        at += 1 if alone else 1 + DIGEST
    return steps


def blocks_of(entries: DataFrame, stage: int, most: int) -> DataFrame:
    """tree, block, n, leaves, nodes, root for every block of ``entries`` (tree, pos, n, digest): n counts the tree's first leaves."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows, n = rows.sort_values("pos"), int(rows.n.iloc[0])
        nodes = build(rows.digest.tolist(), levels_above(n, stage, most))
        return pd.DataFrame({"tree": [rows.tree.iloc[0]], "block": [int(rows.pos.iloc[0]) >> most], "n": [n], "leaves": [len(rows)], "nodes": [nodes], "root": [nodes[:DIGEST]]})

    return entries.groupBy("tree", F.shiftright("pos", most)).applyInPandas(run, "tree string, block long, n long, leaves int, nodes binary, root binary")


def forest(entries: DataFrame, folder: str, most: int) -> list[DataFrame]:
    """The stored blocks of all trees, stage by stage, until each tree has one root; written below ``folder``."""
    stages = []
    while True:
        where = f"{folder}/stage-{len(stages)}"
        blocks_of(entries, len(stages), most).write.parquet(where)
        stages.append(entries.sparkSession.read.parquet(where))
        above = stages[-1].where(F.col("n") > (1 << most * len(stages)))
        if above.isEmpty():
            return stages
        entries = above.select("tree", F.col("block").alias("pos"), "n", F.col("root").alias("digest"))


def paths_down(stages: list[DataFrame], most: int) -> DataFrame:
    """tree, block, above (packed path over its root), top (the tree's root) for every block of the first stage."""
    known = None
    for stage in range(len(stages) - 1, -1, -1):
        last = F.col("n") <= (1 << most * (stage + 1))  # the only block of its tree
        here = stages[stage]
        own = here.where(last).select("tree", "block", F.lit(b"").alias("above"), F.col("root").alias("top"))
        known = own if known is None else own.union(known)
        if not stage:
            return cut_lineage(known)

        def run(rows: pd.DataFrame, stage=stage) -> pd.DataFrame:
            out = []
            for tree, block, n, leaves, nodes, above, top in zip(rows.tree, rows.block, rows.n, rows.leaves, rows.nodes, rows.above, rows.top, strict=True):
                height = levels_above(n, stage, most)
                out += [(tree, (block << most) + k, packed(path(nodes, leaves, height, k)) + above, top) for k in range(leaves)]
            return pd.DataFrame(out, columns=["tree", "block", "above", "top"])

        held = here.join(known.withColumnsRenamed({"tree": "_tree", "block": "_block"}), F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
        known = cut_lineage(held.select("tree", "block", "n", "leaves", "nodes", "above", "top").mapInPandas(
            lambda parts, run=run: (run(p) for p in parts), "tree string, block long, above binary, top binary"))


def proofs(rows: DataFrame, stages: list[DataFrame], above: DataFrame, most: int) -> DataFrame:
    """``rows`` (row, doc_id, tree, pos, digest, tampered) with leaf, subroot, root, proof_sha256, folded_root, verified.

    ``above`` has for each block of the first stage the packed path from its root to the root of all, and its tree's root.
    """

    def run(here: pd.DataFrame, store: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(store):
            block = store.iloc[0]
            height, upper, first = levels_above(int(block.n), 0, most), unpacked(block.above), int(block.block) << most
            for doc_id, pos, digest, tampered in zip(here.doc_id.astype(object).where(here.doc_id.notna(), None), here.pos, here.digest, here.tampered, strict=True):
                steps = path(block.nodes, int(block.leaves), height, int(pos) - first) + upper
                siblings = [s for _, s in steps if s is not None]
                folded = fold(digest if tampered is None else tampered, steps)
                out.append((doc_id, digest.hex(), block.top.hex(), block.root_of_all.hex(), joined(*siblings).hex(), folded.hex(), folded == block.root_of_all))
        frame = pd.DataFrame(out, columns=["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"])
        return frame.assign(doc_id=frame.doc_id.astype("Int64"))

    store = stages[0].join(above.withColumnsRenamed({"tree": "_tree", "block": "_block"}), F.col("tree").eqNullSafe(F.col("_tree")) & (F.col("block") == F.col("_block")))
    store = store.select("tree", "block", "n", "leaves", "nodes", "above", "top", "root_of_all")
    here = rows.select("doc_id", "tree", F.shiftright("pos", most).alias("block"), "pos", "digest", "tampered")
    # a null tree is a group too
    key = [F.coalesce(F.concat(F.lit("+"), "tree"), F.lit("")).alias("key"), F.col("block").alias("at")]
    return here.select("*", *key).groupBy("key", "at").cogroup(store.select("*", *key).groupBy("key", "at")).applyInPandas(
        run, "doc_id long, leaf string, subroot string, root string, proof_sha256 string, folded_root string, verified boolean")


def manifest(docs: DataFrame, *, height: int = HEIGHT) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of every row of ``docs`` (doc_id, text, lang, source, n_chars).

    Within a lang leaves ascend by doc_id, a null one first; rows that repeat a doc_id follow by their digest, and wholly equal rows have places
    of their own. A null lang is a tree of its own, the first. Rows with a null doc_id or n_chars are never tampered with. Other columns are
    left out. An empty table gives no rows. ``height`` is how many levels a block has above its leaves; no result depends on it.
    """
    folder = f"{checkpoint_folder(docs.sparkSession)}/merkle-{uuid.uuid4().hex}"
    rows = cut_lineage(leaf_digests(docs))
    leaves = cut_lineage(numbered(rows.withColumnRenamed("lang", "tree"), "tree", ["doc_id", "digest", "row"]))
    stages = forest(leaves.select("tree", "pos", "n", "digest"), f"{folder}/langs", height)
    inner = paths_down(stages, height)
    trees = numbered(inner.where("block = 0").select(F.lit("").alias("forest"), "tree", F.col("top").alias("digest")), "forest", ["tree"])
    trees = cut_lineage(trees.select(F.col("forest").alias("tree"), F.col("tree").alias("lang"), "pos", "n", "digest"))
    tops = forest(trees.select("tree", "pos", "n", "digest"), f"{folder}/roots", height)
    outer = paths_down(tops, height)

    def climb(parts):
        """The path of each tree's root within its block of the outer tree, and on to the root of all."""
        for part in parts:
            out = []
            for lang, pos, n, leaves, nodes, above, top in zip(part.lang, part.pos, part.n, part.leaves, part.nodes, part.above, part.top, strict=True):
                out.append((lang, packed(path(nodes, leaves, levels_above(n, 0, height), pos & ((1 << height) - 1))) + above, top))
            yield pd.DataFrame(out, columns=["lang", "onward", "root_of_all"])

    store = tops[0].drop("tree", "n", "root").join(outer.drop("tree").withColumnRenamed("block", "_block"), F.col("block") == F.col("_block"))
    met = trees.join(store, F.shiftright("pos", height) == F.col("block")).select("lang", "pos", "n", "leaves", "nodes", "above", "top")
    onward = cut_lineage(met.mapInPandas(climb, "lang string, onward binary, root_of_all binary"))
    whole = inner.join(onward, F.col("tree").eqNullSafe(F.col("lang"))).select("tree", "block", F.concat("above", "onward").alias("above"), "top", "root_of_all")
    return proofs(leaves, stages, whole, height)
