"""What each of five text filters removes alone and in company, from sorted posting lists of failing rows.

Rows are put in order of part and doc_id and numbered; per part and id range a task keeps one ascending list of failing ids for each
filter, and one for each label. A galloping k-way merge over the lists of a range counts the ids by the set of lists they lie in. The
sizes of all unions and differences are sums of those counts, and the sizes of ranges add up to those of a part, so no list is ever
longer than a range and no order of filters is applied to the texts again.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator, Sequence
from itertools import permutations
from math import factorial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wattframe.session import cut_lineage

FILTERS = "ABCDE"
LABELS = ("good", "toxic")
LISTS = (*FILTERS, *LABELS)
#: ids of one posting list at most
RANGE_ROWS = 1 << 16
#: a text that more than one in so many rows repeats is looked up in a broadcast table, which so has at most this many rows
HOT_SHARE = 1000


def text_failures(text: Column) -> Column:
    """Bits of the filters A to D that a text fails: words, distinct words, capitals, special signs. A null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")
    n, different = F.size(words), F.size(F.array_distinct(words))
    capitals = F.length(text) - F.length(F.regexp_replace(text, "[A-Z]+", ""))
    fails = [n < 100, 100 * different.cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike("[#$%&*|]")]
    return sum((f.cast("int") * (1 << k) for k, f in enumerate(fails[1:], 1)), fails[0].cast("int"))


def failing_rows(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """row, part, doc_id, fails (bits of A to E), good, toxic of every row of ``docs`` (doc_id, text, lang).

    E: the whole text equals that of a row with a smaller doc_id; a null doc_id is neither smaller nor larger. A null lang is the part ''.
    A row is good (toxic) if some row of ``labels`` (doc_id, quality, toxic) says so of its doc_id.
    """
    text = F.coalesce(docs["text"], F.lit(""))
    rows = cut_lineage(docs.select(F.monotonically_increasing_id().alias("row"), F.coalesce(docs["lang"], F.lit("")).alias("part"), docs["doc_id"].cast("long").alias("doc_id"),
                                   text_failures(docs["text"]).alias("fails"), F.unhex(F.sha2(text.cast("binary"), 256)).alias("sha")))
    same = cut_lineage(rows.groupBy("sha").agg(F.min("doc_id").alias("least"), F.count(F.lit(1)).alias("n")).where("n > 1"))
    often = F.col("n") > rows.count() / HOT_SHARE
    hot, few = F.broadcast(same.where(often)), same.where(~often)
    repeated = rows.join(hot, "sha").unionByName(rows.join(hot, "sha", "left_anti").join(few, "sha", "left"), allowMissingColumns=True)
    copied = F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))
    marks = labels.groupBy(labels["doc_id"].cast("long").alias("doc_id")).agg(F.max(labels["quality"] == 1).alias("good"), F.max(labels["toxic"] == 1).alias("toxic"))
    flags = [F.coalesce(c, F.lit(False)).alias(c) for c in LABELS]
    return repeated.withColumn("fails", F.col("fails") + copied.cast("int") * 16).join(marks, "doc_id", "left").select("row", "part", "doc_id", "fails", *flags)


def posting_lists(rows: DataFrame) -> DataFrame:
    """part, n, and an ascending list of ids for each of ``LISTS``: one row for each part and id range of ``rows`` (see ``failing_rows``).

    Ids number the rows in order of part, doc_id (null first) and row; n counts the rows of the range, failing or not.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = batch.column(1).dictionary_encode()
            code = parts.indices.to_numpy(zero_copy_only=False)
            ids, fails = batch.column(0).to_numpy(), batch.column(2).to_numpy()
            member = [fails >> k & 1 > 0 for k in range(len(FILTERS))] + [batch.column(k).to_numpy(zero_copy_only=False) for k in (3, 4)]
            edges = np.flatnonzero(np.diff(code, prepend=-1))
            cuts = sorted({len(code), *edges.tolist(), *(a + s for a, b in zip(edges, [*edges[1:], len(code)], strict=True) for s in range(0, b - a, RANGE_ROWS))})
            spans = list(zip(cuts[:-1], cuts[1:], strict=True))
            lists = [pa.array([ids[a:b][m[a:b]] for a, b in spans], pa.list_(pa.int64())) for m in member]
            yield pa.RecordBatch.from_arrays([pa.array([parts.dictionary[int(code[a])].as_py() for a, _ in spans], pa.string()), pa.array([int(b - a) for a, b in spans], pa.int64()), *lists],
                                             names=["part", "n", *LISTS])

    order = ["part", "doc_id", "row"]
    dealt = rows.repartitionByRange(*order).sortWithinPartitions(*order).select(F.monotonically_increasing_id().alias("id"), "part", "fails", *LABELS)
    return dealt.mapInArrow(run, "part string, n long, " + ", ".join(f"{c} array<long>" for c in LISTS))


def gallop(ids: Sequence[int], at: int, goal: int) -> int:
    """The first place from ``at`` on whose id isn't below ``goal``: steps double until they pass it, then the last step is halved."""
    step, end = 1, len(ids)
    while at + step < end and ids[at + step] < goal:
        at += step
        step *= 2
    return bisect_left(ids, goal, at, min(end, at + step))


def merge(lists: Sequence[Sequence[int]]) -> dict[int, int]:
    """How many ids lie in exactly the lists of a set, by the set's bits: one galloping pass over all lists at once."""
    found: dict[int, int] = {}
    live = [[ids[0], 1 << k, 0, ids] for k, ids in enumerate(lists) if len(ids)]
    while live:
        live.sort(key=lambda head: head[0])
        first = live[0]
        if len(live) == 1 or first[0] < live[1][0]:  # a run of ids that no other list holds
            ahead = [first]
            end = len(first[3]) if len(live) == 1 else gallop(first[3], first[2], live[1][0])
            bits, run = first[1], end - first[2]
        else:
            ahead = [h for h in live if h[0] == first[0]]
            bits, run = sum(h[1] for h in ahead), 1
        found[bits] = found.get(bits, 0) + run
        for head in ahead:
            head[2] += run
            head[0] = head[3][head[2]] if head[2] < len(head[3]) else None
        live = [h for h in live if h[0] is not None]
    return found


def set_counts(lists: DataFrame) -> DataFrame:
    """part, bits, n: ids of a part that lie in exactly the lists of ``bits``, in the order of ``LISTS``; bits 0 are the rows that lie in none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(batch.num_rows):
                found = merge([batch.column(2 + j)[k].values.to_pylist() for j in range(len(LISTS))])
                found[0] = batch.column(1)[k].as_py() - sum(found.values())
                yield pa.RecordBatch.from_arrays([pa.array([batch.column(0)[k].as_py()] * len(found), pa.string()), pa.array(list(found), pa.int32()), pa.array(list(found.values()), pa.int64())],
                                                 names=["part", "bits", "n"])

    return lists.mapInArrow(run, "part string, bits int, n long").groupBy("part", "bits").agg(F.sum("n").alias("n"))


def order_table(counts: pd.DataFrame) -> pd.DataFrame:
    """The steps of all orders of the filters for one part, from its at most 128 rows (part, bits, n)."""
    everything = (1 << len(FILTERS)) - 1
    bits, n = counts.bits.to_numpy(), counts.n.to_numpy()
    chosen = {"all": np.ones(len(bits), bool), **{c: bits >> (len(FILTERS) + k) & 1 > 0 for k, c in enumerate(LABELS)}}
    union = {c: [int(n[own & (bits & s > 0)].sum()) for s in range(everything + 1)] for c, own in chosen.items()}
    rows, shapley = [], dict.fromkeys(FILTERS, 0)
    for f, name in enumerate(FILTERS):
        for before in (s for s in range(everything + 1) if not s >> f & 1):
            orders = factorial(before.bit_count()) * factorial(len(FILTERS) - 1 - before.bit_count())
            shapley[name] += orders * (union["all"][before | 1 << f] - union["all"][before])
    for order in permutations(FILTERS):
        before = 0
        for step, name in enumerate(order, 1):
            own = 1 << FILTERS.index(name)
            after = before | own
            gone = {c: u[after] - u[before] for c, u in union.items()}
            rows.append((counts.part.iloc[0], "".join(order), step, int(n.sum()) - union["all"][after], gone["all"], union["all"][own] - gone["all"],
                         union["all"][everything] - union["all"][everything ^ own], gone["good"], gone["toxic"], shapley[name]))
            before = after
    return pd.DataFrame(rows, columns=["part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley"])


def filter_audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows for each part.

    Null and empty texts are equal texts of no words. Rows that repeat a doc_id, or have none, count on their own; the labels of a null
    doc_id are never met. Other columns are left out. An empty table gives no rows; empty labels lose none.
    """
    return set_counts(posting_lists(failing_rows(docs, labels))).groupBy("part").applyInPandas(
        order_table, "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long")
