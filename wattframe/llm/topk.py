"""Exact top-k inner products with multi-resolution segment statistics.

A vector is cut into segments; with a segment's mean m and deviation s, the inner product over it is at most L (m m' + s s') (the
same as the lower bound L ((m - m')^2 + (s - s')^2) on the squared distance). Bounds from one segment, then four, then sixteen drop
candidates that can't reach a query's k-th best so far; exact products are made of the survivors. Queries and candidates meet in
blocks of bounded size, each block pair keeps k rows a query, and those are ranked by query.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wattframe.session import cut_lineage

SEGMENTS = (1, 4, 16)
QUERY_BLOCK, CANDIDATE_BLOCK, CHUNK = 8192, 4096, 256
#: pairs whose bounds or products are made at once
PAIRS = 100_000
#: above this share of pairs a product of all rows with all is cheaper than picking the pairs
DENSE = 0.1


def segment_features(vectors: np.ndarray, segments: int) -> np.ndarray:
    """Rows whose plain products bound the vectors' products from above: means and deviations times the root of the length."""
    edges = np.unique(np.linspace(0, vectors.shape[1], min(segments, vectors.shape[1]) + 1).astype(int))
    starts, sizes = edges[:-1], np.diff(edges)
    means = np.add.reduceat(vectors, starts, axis=1) / sizes
    squares = np.add.reduceat((vectors - np.repeat(means, sizes, axis=1)) ** 2, starts, axis=1) / sizes
    return np.concatenate([means, np.sqrt(squares)], 1) * np.sqrt(np.concatenate([sizes, sizes]))


def exact_products(a: np.ndarray, b: np.ndarray, paired: bool = False) -> np.ndarray:
    """Integer inner products of all rows with all rows, or row by row; in float64 as long as that is exact."""
    top = float(np.abs(a).max(initial=0)) * float(np.abs(b).max(initial=0)) * a.shape[1]
    if top < 2**53:
        a, b = a.astype(np.float64), b.astype(np.float64)
    out = np.einsum("ij,ij->i", a, b) if paired else a @ b.T
    return out.astype(np.int64)


def block_top(queries: np.ndarray, candidates: np.ndarray, own: np.ndarray, k: int, seen: list[int] | None = None) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(query, its best candidates, their products) with ties to the lower number; ``own`` is a query's own candidate or -1.

    The coarsest bound is made for all pairs; each finer one, and the exact product, for the pairs that the one before left, unless those are over DENSE of
    all. ``seen``, if given, gets the number of pairs at each level and of exact products, added up.
    """
    count = len(candidates)
    levels = [segment_features(candidates.astype(np.float64), s) for s in SEGMENTS]
    for lo in range(0, len(queries), CHUNK):
        part = queries[lo:lo + CHUNK]
        rows = np.arange(len(part))
        wide = part.astype(np.float64)
        bound = segment_features(wide, SEGMENTS[0]) @ levels[0].T
        self_at = own[lo:lo + CHUNK]
        has = self_at >= 0
        bound[rows[has], self_at[has]] = -np.inf
        take = min(k, count)
        seed = np.argpartition(bound, count - take, axis=1)[:, count - take:]
        first = exact_products(np.repeat(part, take, axis=0), candidates[seed.ravel()], True).reshape(len(part), take).astype(np.float64)
        first[np.isneginf(np.take_along_axis(bound, seed, 1))] = -np.inf
        floor = first.min(1)[:, None] if count >= k else np.full((len(part), 1), -np.inf)
        scale = np.linalg.norm(wide, axis=1)[:, None] * np.linalg.norm(candidates.astype(np.float64), axis=1)[None, :]
        slack = 1 + 1e-9 * scale  # rounding of the bounds
        alive = np.isfinite(bound) & (bound + slack >= floor)
        counts = [bound.size]
        for segments, level in zip(SEGMENTS[1:], levels[1:], strict=True):
            left = int(alive.sum())
            asked = segment_features(wide, segments)
            if left > DENSE * alive.size:  # so few went that one product of all costs less than picking
                counts.append(alive.size)
                alive &= asked @ level.T + slack >= floor
                continue
            counts.append(left)
            i, j = np.nonzero(alive)
            for at in range(0, left, PAIRS):
                s = slice(at, at + PAIRS)
                alive[i[s], j[s]] = np.einsum("ij,ij->i", asked[i[s]], level[j[s]]) + slack[i[s], j[s]] >= floor[i[s], 0]
        left = int(alive.sum())
        counts.append(alive.size if left > DENSE * alive.size else left)
        if seen is not None:
            seen[:] = counts if not seen else [x + y for x, y in zip(seen, counts, strict=True)]
        score = np.full(alive.shape, np.iinfo(np.int64).min)
        if left > DENSE * alive.size:
            score[alive] = exact_products(part, candidates)[alive]
        else:
            i, j = np.nonzero(alive)
            for at in range(0, left, PAIRS):
                s = slice(at, at + PAIRS)
                score[i[s], j[s]] = exact_products(part[i[s]], candidates[j[s]], True)
        for r in rows:
            hit = np.flatnonzero(alive[r])
            if len(hit) > k:
                value = score[r, hit]
                hit = hit[value >= np.partition(value, len(hit) - k)[len(hit) - k]]
            hit = hit[np.lexsort((hit, -score[r, hit]))][:k]
            yield lo + int(r), hit, score[r, hit]


def top_products(vectors: DataFrame, is_query: Column, *, k: int = 20, scale: int = 64, vec_id: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: the k highest integer inner products of every query row with every other row.

    Components are floor(scale * x), x as double. Ties go to the smaller vec_id. Rows whose vector is null or holds a null or non-finite
    component, or whose vec_id is null, take no part; a shorter vector counts as filled up with zeros. Repeated rows are rows of
    their own: a query isn't compared with itself but with its copies. With fewer than k others all come back; an empty table gives
    no rows. Products are taken to fit 64 bits.
    """
    usable = vectors.select(vectors[f"`{vec_id}`"].cast("long").alias("vec_id"), vectors[f"`{vector}`"].cast("array<double>").alias("v"), is_query.alias("query"))
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    usable = usable.where(F.col("vec_id").isNotNull() & F.col("v").isNotNull() & finite)
    whole = F.transform("v", lambda x: F.floor(x * scale).cast("long"))
    rows = cut_lineage(usable.select("vec_id", whole.alias("v"), F.coalesce("query", F.lit(False)).alias("query"), F.monotonically_increasing_id().alias("row")))
    n = rows.agg(F.count(F.lit(1)).alias("rows"), F.count_if("query").alias("queries"), F.max(F.size("v")).alias("dims")).first()
    across, down, dims = max(1, -(-n.rows // CANDIDATE_BLOCK)), max(1, -(-n.queries // QUERY_BLOCK)), max(1, n.dims or 0)
    mine = F.expr(f"pmod(xxhash64(row), {across})").cast("int")
    asks = rows.where("query").withColumn("down", F.expr(f"pmod(xxhash64(row, 1), {down})").cast("int"))
    asks = asks.withColumn("across", F.explode(F.sequence(F.lit(0), F.lit(across - 1))))
    answers = rows.withColumn("across", mine).withColumn("down", F.explode(F.sequence(F.lit(0), F.lit(down - 1)))).withColumn("query", F.lit(False))
    columns = ["across", "down", "query", "row", "vec_id", "v"]

    def matrix(column: pa.ChunkedArray) -> np.ndarray:
        lists = column.combine_chunks()
        sizes = np.diff(lists.offsets.to_numpy())
        flat = lists.flatten().to_numpy(zero_copy_only=False)
        if (sizes == dims).all():
            return flat.reshape(-1, dims)
        out = np.zeros((len(sizes), dims), np.int64)
        at = np.repeat(np.arange(len(sizes)), sizes)
        out[at, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
        return out

    def run(table: pa.Table) -> pa.Table:
        table = table.select(["query", "row", "vec_id", "v"]).sort_by([("vec_id", "ascending"), ("row", "ascending")])
        query = table["query"].to_numpy()
        q, c = table.filter(pa.array(query)), table.filter(pa.array(~query))
        ids, numbers = c["vec_id"].to_numpy(), c["row"].to_numpy()
        out: list[pa.Table] = []
        if len(q) and len(c):
            place = pd.Series(np.arange(len(c)), numbers)
            own = place.reindex(q["row"].to_numpy()).fillna(-1).to_numpy().astype(np.int64)
            found = list(block_top(matrix(q["v"]), matrix(c["v"]), own, k))
            sizes = [len(h) for _, h, _ in found]
            hits = np.concatenate([h for _, h, _ in found])
            asked = np.repeat([i for i, _, _ in found], sizes)
            out = [pa.table({"ask": q["row"].to_numpy()[asked], "query_id": q["vec_id"].to_numpy()[asked], "row": numbers[hits], "vec_id": ids[hits],
                             "score": np.concatenate([s for _, _, s in found])})]
        shape = pa.schema([(n, pa.int64()) for n in ("ask", "query_id", "row", "vec_id", "score")])
        return out[0].cast(shape) if out else shape.empty_table()

    near = asks.select(columns).union(answers.select(columns)).groupBy("across", "down").applyInArrow(
        run, "ask long, query_id long, row long, vec_id long, score long")
    order = Window.partitionBy("ask").orderBy(F.col("score").desc(), "vec_id", "row")
    return near.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
