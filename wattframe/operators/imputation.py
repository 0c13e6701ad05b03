"""Imputation fitted on training rows."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.operators.quantiles import quantiles


def impute_median(df: DataFrame, train: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Fill NULLs with the exact median of the training rows, or 0 where there is none."""
    long = train.select(*[F.col(c).cast("double").alias(c) for c in cols]).unpivot([], list(cols), "_col", "_v")
    meds = quantiles(long, ["_col"], "_v", {"med": 0.5})
    table = meds.agg(F.map_from_entries(F.collect_list(F.struct("_col", "med"))))
    out = df.withColumn("_meds", table.scalar())
    return out.select(*[F.coalesce(c, F.try_element_at("_meds", F.lit(c)), F.lit(0.0)).alias(c) if c in cols else F.col(c)
                        for c in df.columns])
