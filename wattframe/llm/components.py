"""Connected components of a link table by hooking and contraction."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wattframe.session import cut_lineage


def components(links: DataFrame) -> DataFrame:
    """node, label for every node of ``links`` (a, b: long, not null): equal labels for nodes that are connected, a label being one of them.

    Each round every node takes its smallest neighbour, chains are shortened, and links between nodes of one label vanish, so
    the links shrink to nothing in about as many rounds as the logarithm of a component's diameter. No links give no rows.
    """
    links = cut_lineage(links.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct())
    labels = None
    while labels is None or not links.isEmpty():
        both = links.union(links.select("b", "a"))
        up = both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("a"), F.min("b")).alias("up"))
        upper = up.select(F.col("node").alias("up"), F.col("up").alias("top"))
        step = cut_lineage(up.join(upper, "up").select("node", F.col("top").alias("label")))
        if labels is None:
            labels = step
        else:
            onward = step.select(F.col("node").alias("label"), F.col("label").alias("next"))
            labels = cut_lineage(labels.join(onward, "label", "left").select("node", F.coalesce("next", "label").alias("label")))
        ends = [step.select(F.col("node").alias(c), F.col("label").alias(f"_{c}")) for c in "ab"]
        moved = links.join(ends[0], "a").join(ends[1], "b").where("_a <> _b")
        links = cut_lineage(moved.select(F.least("_a", "_b").alias("a"), F.greatest("_a", "_b").alias("b")).distinct())
    return labels
