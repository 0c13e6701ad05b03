"""Query registry: a Spark callable and, where SQL can express the result, the SQL text."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wattframe.suite.views import Views, with_views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(views)`` under ``name``."""

    def register(fn):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, sf_dir: fn(Views(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return fn

    return register


def rounded(df: DataFrame, digits: int, *cols: str) -> DataFrame:
    """Round float columns, as order-dependent float sums differ in the last bits between engines."""
    names = set(cols or [f for f, t in df.dtypes if t in ("double", "float")])
    # adding 0.0 turns a rounded -0.0 into 0.0
    return df.select(*[(F.round(c, digits) + F.lit(0.0)).alias(c) if c in names else F.col(c)
                       for c in df.columns])
