"""Session settings the models rely on."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def build_session(app: str = "terralake", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution on and all instants read as UTC.

    Sizes are left to the cluster: start from many shuffle partitions and let
    adaptive execution merge the small ones and split the skewed ones.
    """
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
    )
    if master:
        builder = builder.master(master)
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return use_utc(builder.getOrCreate())


def use_utc(spark: SparkSession) -> SparkSession:
    """Local days are derived from explicit zone columns, so the session is UTC."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def ensure_checkpoint_dir(spark: SparkSession) -> str:
    """The shared checkpoint folder named by the cluster; a private one only where driver and executors are one process.

    RuntimeError on a cluster without the setting: executors would write to their own disks.
    """
    configured = spark.conf.get("spark.checkpoint.dir", None)
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not configured:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        configured = tempfile.mkdtemp(prefix="terralake-checkpoint-")
    spark.sparkContext.setCheckpointDir(configured)
    return configured
