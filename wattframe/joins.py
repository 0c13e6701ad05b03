"""Equality joins that keep NULL keys."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def on_keys(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Join on ``keys`` where NULL equals NULL; the keys of the result are those of ``left``, in a full join of either side.

    Without keys ``right`` has one row, which goes to every row of ``left`` as a scalar subquery.
    """
    if not keys:
        one = right.select(F.struct(*right.columns)).scalar()
        return left.withColumn("__right", one).select(*left.columns, "__right.*")
    there = {k: f"__right_{i}" for i, k in enumerate(keys)}
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(r)) for k, r in there.items()])
    found = left.join(right.withColumnsRenamed(there), same, how)
    if how == "full":  # a side that has no row has no keys; a key that is NULL on both sides stays NULL
        found = found.withColumns({k: F.coalesce(k, r) for k, r in there.items()})
    return found.drop(*there.values())
