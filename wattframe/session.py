"""Session construction and the few session-level facts the library relies on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "wattframe", master: str | None = None, **conf: str) -> SparkSession:
    """A session with UTC time, AQE with skew handling, and Arrow transfer.

    Partition counts are left to the cluster unless passed in ``conf``; AQE coalesces or splits from there.
    """
    builder = SparkSession.builder.appName(app)
    if master:
        builder = builder.master(master)
    settings = {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
        "spark.cleaner.referenceTracking.cleanCheckpoints": "true",
        **{k.replace("__", "."): v for k, v in conf.items()},
    }
    for key, value in settings.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def checkpoint_folder(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; one of this machine only where none is set and all runs on this machine."""
    sc = spark.sparkContext
    configured = sc.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    current = sc.getCheckpointDir()
    if configured:
        if current is None:
            sc.setCheckpointDir(configured)
        return configured
    if current is None:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        current = tempfile.mkdtemp(prefix="spark-checkpoint-")
        sc.setCheckpointDir(current)
    return current


def cut_lineage(df):
    """Materialise ``df`` in the reliable checkpoint folder, so lost executors do not replay its history."""
    checkpoint_folder(df.sparkSession)
    return df.checkpoint(eager=True)
