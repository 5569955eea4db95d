"""Session settings for tests and benchmarks; on a cluster the caller's session is used as it is."""

from __future__ import annotations

import tempfile

from pyspark.sql import SparkSession


def local_session(cpus: int = 8) -> SparkSession:
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("trialgrid")
        .config("spark.sql.shuffle.partitions", str(cpus))
        .config("spark.sql.adaptive.enabled", "true")
        # small test data, compute-heavy stages: keep them on all cores
        .config("spark.sql.adaptive.coalescePartitions.minPartitionSize", "64k")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder named by the cluster. Only a session whose executors are the driver itself may do without one (tests)."""
    context = spark.sparkContext
    current = context.getCheckpointDir()
    path = spark.conf.get("spark.checkpoint.dir", None)
    if current and (not path or path in current):
        return current
    if not path and not (context.master == "local" or context.master.startswith("local[")):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    context.setCheckpointDir(path or tempfile.mkdtemp(prefix="spark-", dir="/tmp"))
    return context.getCheckpointDir()
