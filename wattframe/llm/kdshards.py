"""Sharding by a k-d tree over document metadata, split at distributed weighted medians.

All nodes of a level are split together. Each takes the metadata dimension in which its documents spread widest and is cut where
the bytes to its left fit the shards it gives there: byte sums by node and key bucket show the boundary bucket, and only that one
is summed again by finer buckets. The driver keeps one cut per shard, and a document's shard is an expression of its own
metadata. Equal texts share their metadata (the smallest of the group), so a cut leaves a group whole unless it is large.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.session import cut_lineage

#: a cut key is the place along the dimension, then bits of the text's hash, then bits of the row's hash
PLACE_BITS, TEXT_BITS, ROW_BITS, STEP = 24, 12, 12, 12
#: a group of equal texts is cut itself only if it holds more than this share of a shard's bytes
GROUP_SHARE = 0.01
SLOT_ROWS = 50_000
#: a text that more than one in so many rows hold is looked up in a broadcast table, which so has at most this many rows
HOT_SHARE = 1000


@dataclass
class Node:
    """A node by its number in the tree: the root is 1, the children of i are 2i and 2i + 1."""

    first: int
    shards: int
    dim: int = 0
    low: float = 0.0
    high: float = 0.0
    cut: int = 1 << (PLACE_BITS + TEXT_BITS + ROW_BITS)  # beyond all keys

    @property
    def scale(self) -> float:
        return (2**PLACE_BITS - 1) / (self.high - self.low) if self.high > self.low else 0.0


class Tree:
    def __init__(self, shards: int, dims: int):
        self.dims, self.depth, self.nodes = dims, 0, {1: Node(0, shards)}

    def leaves(self) -> dict[int, Node]:
        return {i: n for i, n in self.nodes.items() if i >> self.depth}

    def _of(self, values, at: Column) -> Column:
        """The value that belongs to a node's number, from a literal array with an entry for each number."""
        blank = Node(0, 1)
        return F.element_at(F.array(*[F.lit(values(self.nodes.get(i, blank))) for i in range(1, 2 << self.depth)]), at.cast("int"))

    def key(self, at: Column) -> Column:
        where = F.element_at(F.array(*[F.col(f"_d{k}") for k in range(self.dims)]), self._of(lambda n: n.dim + 1, at))
        place = F.floor((where - self._of(lambda n: float(n.low), at)) * self._of(lambda n: n.scale, at)).cast("long")
        return (place * 2**TEXT_BITS + F.col("_text")) * 2**ROW_BITS + F.col("_row")

    def leaf(self) -> Column:
        """The number of the node at the present depth that a row falls into."""
        steps = F.array(*[F.lit(k) for k in range(self.depth)]) if self.depth else F.array().cast("array<int>")
        return F.aggregate(steps, F.lit(1), lambda at, _: (at * 2 + (self.key(at) >= self._of(lambda n: n.cut, at)).cast("int")).cast("int"))

    def shard(self) -> Column:
        return self._of(lambda n: n.first, self.leaf())

    def grow(self) -> None:
        """Children below all nodes of the last level; a node of one shard passes its rows on to the left."""
        for i, n in self.leaves().items():
            left = max(1, n.shards // 2)
            self.nodes[2 * i] = Node(n.first, left)
            if n.shards > 1:
                self.nodes[2 * i + 1] = Node(n.first + left, n.shards - left)
        self.depth += 1


def _number(name: str, kind: str) -> Column:
    """A metadata column as a number that keeps its order: strings by their first six bytes; null below all."""
    if kind == "string":
        head = F.substring(F.encode(F.col(name), "UTF-8"), 1, 6)
        return F.coalesce(F.conv(F.rpad(F.hex(head), 12, "0"), 16, 10).cast("double"), F.lit(-1.0))
    value = F.col(name).cast("double")
    return F.coalesce(F.when(~F.isnan(value), value), F.lit(-1.0))


def _boundary(keys: DataFrame, wanted: dict[int, float], low_bits: int, within: dict[int, int]) -> dict[int, tuple[int, float, float]]:
    """Per node the bucket of ``low_bits`` coarser keys in which ``wanted`` bytes end, the bytes before it and its own."""
    hit = None
    for node in wanted:
        rows = F.col("node") == node
        if node in within:
            rows &= F.shiftright("key", low_bits + STEP) == within[node]
        hit = rows if hit is None else hit | rows
    sums = keys.where(hit).groupBy("node", F.shiftright("key", low_bits).alias("bucket")).agg(F.sum("size").alias("own"))
    sums = sums.withColumn("upto", F.sum("own").over(Window.partitionBy("node").orderBy("bucket")))
    goal = F.create_map(*[F.lit(x) for n, w in wanted.items() for x in (n, float(w))])[F.col("node")]
    found = sums.where((F.col("upto") > goal) & (F.col("upto") - F.col("own") <= goal)).collect()  # one row per node
    return {r.node: (r.bucket, r.upto - r.own, r.own) for r in found}


def _split_level(base: DataFrame, tree: Tree, wide: list[tuple[float, float]], share: float) -> None:
    dims, leaves = range(tree.dims), tree.leaves()
    stats = base.groupBy(tree.leaf().alias("node")).agg(
        F.sum("size").alias("bytes"), *[f(f"_d{d}").alias(f"{m}{d}") for d in dims for m, f in (("lo", F.min), ("hi", F.max))])
    wanted: dict[int, float] = {}
    for r in stats.collect():  # one row per node
        n = leaves[r.node]
        if n.shards > 1:
            n.dim = max(dims, key=lambda d: (r[f"hi{d}"] - r[f"lo{d}"]) / ((wide[d][1] - wide[d][0]) or 1.0))
            n.low, n.high = r[f"lo{n.dim}"], r[f"hi{n.dim}"]
            wanted[r.node] = r.bytes * (n.shards // 2) / n.shards
    per_shard = {k: w / (leaves[k].shards // 2) for k, w in wanted.items()}
    keys = base.select(tree.leaf().alias("node"), *[f"_d{d}" for d in dims], "_text", "_row", "size")
    keys = keys.select("node", tree.key(F.col("node")).alias("key"), "size")
    within: dict[int, int] = {}
    for low in range(PLACE_BITS + TEXT_BITS + ROW_BITS - STEP, -1, -STEP):
        if not wanted:
            break
        for k, (bucket, before, own) in _boundary(keys, wanted, low, within).items():
            within[k] = bucket
            left = wanted[k] - before
            leaves[k].cut = (bucket + (own - left < left)) << low
            # whole groups stay together unless they are large; with all bits used the nearer side is final
            if low == ROW_BITS and own <= share * per_shard[k] or low == 0:
                del wanted[k]
            else:
                wanted[k] = left
    tree.grow()


def kd_shards(docs: DataFrame, *, shards: int | None = None, target_bytes: int | None = None, dimensions: tuple[str, ...] = ("source", "lang", "size", "doc_id"),
              group_share: float = GROUP_SHARE) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot, grown_shard of every row.

    Leaves are ``shards``, or as many as give ``target_bytes`` each. Size is the UTF-8 bytes of the text (null: none) plus 8. A null in
    a dimension lies below all its values. Rows of equal texts and repeated rows may be cut apart only in large groups. A table
    without rows gives no rows; with fewer rows than shards some shards stay empty. Other columns are left out.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = docs.select(F.monotonically_increasing_id().alias("_id"), docs["doc_id"], (F.octet_length(text) + 8).cast("long").alias("size"),
                       F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("_hash"),
                       *[docs[d].alias(f"_c{k}") for k, d in enumerate(dimensions) if d != "size"])
    kinds = dict(docs.dtypes)
    numbers = [(F.log2("size") if d == "size" else _number(f"_c{k}", kinds[d])).alias(f"_d{k}") for k, d in enumerate(dimensions)]
    rows = cut_lineage(rows.select("_id", "doc_id", "size", "text_crc32", "_hash", *numbers))
    same, dims = ["_hash", "text_crc32", "size"], range(len(dimensions))
    group = cut_lineage(rows.groupBy(*same).agg(*[F.min(f"_d{k}").alias(f"_m{k}") for k in dims], F.count(F.lit(1)).alias("_n")).where("_n > 1"))
    often = F.col("_n") > rows.count() / HOT_SHARE
    hot, few = F.broadcast(group.where(often)), group.where(~often)
    met = rows.join(hot, same).unionByName(rows.join(hot, same, "left_anti").join(few, same, "left"))
    base = cut_lineage(met.select("_id", "doc_id", "size", "text_crc32", *[F.coalesce(f"_m{k}", f"_d{k}").alias(f"_d{k}") for k in dims],
                                  F.expr(f"pmod(_hash, {2**TEXT_BITS})").alias("_text"), F.expr(f"pmod(xxhash64(_id), {2**ROW_BITS})").alias("_row")))
    total = base.agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("n"),
                     *[f(f"_d{k}").alias(f"{m}{k}") for k in range(len(dimensions)) for m, f in (("lo", F.min), ("hi", F.max))]).first()
    if shards is None:
        shards = max(1, -(-(total.bytes or 0) // target_bytes))
    tree = Tree(shards, len(dimensions))
    while total.n and any(n.shards > 1 for n in tree.leaves().values()):
        _split_level(base, tree, [(total[f"lo{k}"], total[f"hi{k}"]) for k in range(len(dimensions))], group_share)
    placed = base.select("_id", "doc_id", "size", "text_crc32", tree.shard().alias("shard"))
    return with_slots(placed, shards, total.n).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot",
                                                      F.lit(None).cast("int").alias("grown_shard"))


def with_slots(placed: DataFrame, shards: int, rows: int) -> DataFrame:
    """Adds slot, gapless from 0 in each shard: numbered inside parts of a shard, after the rows of the parts before."""
    parts = max(-(-rows // (shards * SLOT_ROWS)), -(-int(placed.sparkSession.conf.get("spark.sql.shuffle.partitions")) // shards))
    dealt = placed.withColumn("_part", F.expr(f"pmod(xxhash64(_id), {parts})"))
    sizes = dealt.groupBy("shard", "_part").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    first = sizes.select("shard", "_part", before.alias("_first"))
    own = F.row_number().over(Window.partitionBy("shard", "_part").orderBy("doc_id", "_id")) - 1
    return dealt.withColumn("_own", own).join(first, ["shard", "_part"]).withColumn("slot", (F.col("_first") + F.col("_own")).cast("long"))
