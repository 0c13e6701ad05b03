"""Exact dedup by a sharded cuckoo-filter index of live text digests.

The SHA-256 of each whole normalised text decides. Digests are dealt to shards by their first bits; each shard keeps a cuckoo
filter (16-bit fingerprints, four slots a bucket) and, under the filter's bucket numbers, the full digests with what is known
of their group. A filter miss is a new digest; a hit is verified against the bucket's content. Where an insertion finds no
free slot the filter is doubled and filled again from the stored keys.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.llm.text import LOWER, text_slices
from wattframe.session import cut_lineage

SLOTS, KICKS = 4, 200
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: rows of one shard at most, on average; the number of shards grows with the table
SHARD_ROWS = 100_000
#: a digest reaches its shard in at most so many partial rows, however many copies it has
SALTS = 16


class CuckooFilter:
    """Approximate membership of 64-bit hashes with deletion; buckets are a power of two."""

    def __init__(self, buckets: int):
        self.mask = buckets - 1
        self.table = [[] for _ in range(buckets)]
        self.state = 1

    def places(self, h: int) -> tuple[int, int, int]:
        mark = (h >> 48) or 1
        first = h & self.mask
        return mark, first, first ^ (mark * 0x5BD1E995 & self.mask)

    def __contains__(self, h: int) -> bool:
        mark, a, b = self.places(h)
        return mark in self.table[a] or mark in self.table[b]

    def insert(self, h: int) -> bool:
        mark, a, b = self.places(h)
        for at in (a, b):
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        at = b
        for _ in range(KICKS):
            self.state = (self.state * 1103515245 + 12345) & 0x7FFFFFFF
            slot = (self.state >> 16) % SLOTS
            mark, self.table[at][slot] = self.table[at][slot], mark
            at ^= mark * 0x5BD1E995 & self.mask
            if len(self.table[at]) < SLOTS:
                self.table[at].append(mark)
                return True
        return False  # a mark is lost: the owner fills a larger filter from its keys

    def delete(self, h: int) -> None:
        mark, a, b = self.places(h)
        self.table[a if mark in self.table[a] else b].remove(mark)


class CuckooIndex:
    """Live digests with a value each; the filter answers for the absent ones, the buckets' content for the rest."""

    def __init__(self, buckets: int = 64):
        self.resizes = 0
        self.false_hits = 0
        self._fill(buckets, [])

    def _fill(self, buckets: int, entries: list) -> None:
        while True:
            self.filter = CuckooFilter(buckets)
            self.content: dict[int, list] = {}
            if all(self._put(e) for e in entries):
                return
            buckets *= 2

    @staticmethod
    def _hash(key: bytes) -> int:
        return int.from_bytes(key[8:16], "little")

    def _put(self, entry: list) -> bool:
        h = self._hash(entry[0])
        self.content.setdefault(h & self.filter.mask, []).append(entry)
        return self.filter.insert(h)

    def entries(self) -> Iterator[list]:
        for bucket in self.content.values():
            yield from bucket

    def get(self, key: bytes) -> list | None:
        h = self._hash(key)
        if h not in self.filter:
            return None
        for entry in self.content.get(h & self.filter.mask, ()):
            if entry[0] == key:
                return entry
        self.false_hits += 1
        return None

    def insert(self, key: bytes, value) -> None:
        """For a key that isn't live."""
        if not self._put([key, value]):
            self.resizes += 1
            self._fill((self.filter.mask + 1) * 2, list(self.entries()))

    def delete(self, key: bytes) -> bool:
        """Takes a live key out; False, and nothing is changed, if the key isn't live."""
        entry = self.get(key)
        if entry is None:
            return False
        h = self._hash(key)
        self.content[h & self.filter.mask].remove(entry)
        self.filter.delete(h)
        return True


def text_digests(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """row_id, doc_id, digest of every row: SHA-256 of the whole text with A-Z lowered; a null text counts as empty."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests = []
            for _, _, data, offsets in text_slices(batch.column(2)):
                raw = memoryview(LOWER[data])
                digests += [hashlib.sha256(raw[a:b]).digest() for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary())], names=["row_id", "doc_id", "digest"])

    rows = docs.select(F.monotonically_increasing_id().alias("row_id"), docs[f"`{doc_id}`"].cast("long").alias("doc_id"), docs[f"`{text}`"].alias("text"))
    return rows.mapInArrow(run, "row_id long, doc_id long, digest binary")


def apply_changes(changes: DataFrame, shards: int) -> DataFrame:
    """Live groups after the changes of each digest are applied in the order of ``step``: digest, keep_id, keep_row, group_size.

    ``changes`` has digest, step (long), keep_id, keep_row, group_size and removed (boolean: the digest leaves the index). A stored
    index is put in again by passing its rows as first changes. A shard without live digests gives no rows.
    """

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        index = CuckooIndex()
        rows = rows.sort_values("step", kind="stable")
        for key, doc, row, size, removed in zip(rows.digest, rows.keep_id.astype(object).where(rows.keep_id.notna(), None), rows.keep_row, rows.group_size,
                                                rows.removed, strict=True):
            if removed:
                index.delete(key)
            elif (entry := index.get(key)) is None:
                index.insert(key, (doc, row, size))
            else:
                entry[1] = (*max(entry[1][:2], (doc, row), key=_order), entry[1][2] + size)
        live = [(k, *v) for k, v in index.entries()]
        out = pd.DataFrame(live, columns=["digest", "keep_id", "keep_row", "group_size"])
        return out.assign(keep_id=out.keep_id.astype("Int64"))

    # the first eight hex digits deal to shards, other bits of the digest to buckets
    shard = F.conv(F.substring(F.hex("digest"), 1, 8), 16, 10).cast("long") % shards
    wide = changes.select("digest", "step", "keep_id", "keep_row", "group_size", "removed", shard.alias("shard"))
    return wide.groupBy("shard").applyInPandas(run, "digest binary, keep_id long, keep_row long, group_size long")


def _order(pair):
    return pair[0] is not None, pair[0] or 0, pair[1]


def exact_dedup(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Of equal texts the row with the largest doc_id stays, a null doc_id below all others; of repeated rows with that doc_id just
    one. Null and empty texts are equal to each other. An empty table gives no rows. Other columns are left out.
    """
    rows = cut_lineage(text_digests(docs, doc_id, text))  # slim, and row_id must not change when a task runs again
    spark = docs.sparkSession
    shards = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // SHARD_ROWS))
    # nulls first in the order of structs, so the largest is right; a hot digest is folded before it meets its shard
    top = F.max(F.struct("doc_id", "row_id"))
    partial = rows.groupBy("digest", (F.col("row_id") % SALTS).alias("step")).agg(top.alias("top"), F.count(F.lit(1)).alias("group_size"))
    live = apply_changes(partial.select("digest", "step", F.col("top.doc_id").alias("keep_id"), F.col("top.row_id").alias("keep_row"), "group_size",
                                        F.lit(False).alias("removed")), shards)
    return rows.join(live, "digest").select("row_id", "doc_id", "keep_id", "group_size", (F.col("row_id") == F.col("keep_row")).alias("kept"),
                                            F.lower(F.hex("digest")).alias("text_sha256"))


def distinct_texts(docs: DataFrame) -> DataFrame:
    """The rows of ``docs`` (doc_id, text and more) that stay: one of each group of equal texts."""
    found = cut_lineage(exact_dedup(docs))
    fates = found.groupBy("doc_id", "text_sha256").agg(F.max("kept").alias("kept"), F.count(F.lit(1)).alias("n"))
    # only what goes, and the rare rows that repeat both doc_id and text, need a word with the texts
    fates = cut_lineage(fates.where("n > 1 OR NOT kept").select(F.col("doc_id").alias("__d"), F.col("text_sha256").alias("__s"), F.col("kept").alias("__k")))
    sha = F.sha2(F.translate(F.coalesce("text", F.lit("")), UPPER, UPPER.lower()), 256)
    rows = docs.withColumn("__sha", sha)
    same = F.col("doc_id").eqNullSafe(F.col("__d")) & (F.col("__sha") == F.col("__s"))
    single = rows.join(fates, same, "left_anti")
    if fates.where("__k").isEmpty():  # no repeated rows, so the texts needn't be dealt for them
        return single.select(*docs.columns)
    repeated = rows.join(fates.where("__k"), same, "left_semi").dropDuplicates(["doc_id", "__sha"])
    return single.union(repeated).select(*docs.columns)
