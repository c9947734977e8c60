"""Session settings the operators rely on."""

from __future__ import annotations

import os

from pyspark.sql import SparkSession


def prepare(spark: SparkSession) -> SparkSession:
    """Apply the settings that change results or plans, leaving cluster sizing alone.

    Shuffle parallelism is only touched for a local master that still has Spark's default of 200;
    on a cluster AQE coalesces from whatever the operator of the cluster configured.
    """
    conf = spark.conf
    conf.set("spark.sql.session.timeZone", "UTC")
    conf.set("spark.sql.adaptive.enabled", "true")
    conf.set("spark.sql.adaptive.skewJoin.enabled", "true")
    conf.set("spark.sql.variant.allowDuplicateKeys", "true")  # the last of equal keys counts, as in any JSON reader
    if spark.sparkContext.master.startswith("local") and conf.get("spark.sql.shuffle.partitions") == "200":
        conf.set("spark.sql.shuffle.partitions", "8")
    return spark


def local_session(cores: int | str = "*", memory: str = "8g") -> SparkSession:
    """A local session for tests and the bench."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("fleetsight")
        .config("spark.driver.memory", os.environ.get("FLEETSIGHT_DRIVER_MEMORY", memory))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        # Call-site capture costs several driver round trips per column expression; plans here have hundreds.
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
    )
    spark = prepare(builder.getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def ensure_checkpoint_dir(spark: SparkSession, fallback: str | None = None) -> str:
    """Directory for checkpoints: the cluster's ``spark.checkpoint.dir``, else ``fallback`` for tests."""
    configured = spark.conf.get("spark.checkpoint.dir", None)
    path = configured or fallback
    if path is None:
        raise ValueError("spark.checkpoint.dir is not set; name a folder all executors share")
    spark.sparkContext.setCheckpointDir(path)
    return path
