"""Session helpers shared by tests, the bench and ad hoc runs."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cpus: str = "8", shuffle_partitions: int = 8) -> SparkSession:
    """A single-JVM session; on a cluster the caller brings its own session and settings."""
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("lumenfold")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", "8g")
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def table(spark: SparkSession, sf_dir: str, name: str):
    """One of the driver's Parquet tables; any Hadoop path or URI works."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame) -> DataFrame:
    """df dealt evenly over as many partitions as a shuffle of the session has: before work that costs far more than its rows' bytes, as a small file is one split however many rows it has."""
    parts = df.sparkSession.conf.get("spark.sql.shuffle.partitions")
    return df.repartition(max(df.sparkSession.sparkContext.defaultParallelism, int(parts) if parts.isdigit() else 0))


def scratch(spark: SparkSession, name: str) -> str:
    """A new folder's path below the session's checkpoint folder, which every executor reaches."""
    durable(spark.range(0))  # sees to it that there is one
    return f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{name}-{uuid.uuid4().hex}"


def durable(df: DataFrame) -> DataFrame:
    """df as a reliable checkpoint: computed once, lineage cut, kept where every executor can read it.

    The folder is the session's spark.checkpoint.dir; only where none is set (tests on one
    machine) a temporary one is made; a cluster without the setting is an error.
    """
    sc = df.sparkSession.sparkContext
    if not sc._jsc.sc().getCheckpointDir().isDefined():
        folder = sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc.master.startswith("local["):
            raise ValueError("a cluster needs spark.checkpoint.dir: a folder that the driver and all executors reach")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lumenfold-"))
    return df.checkpoint(eager=True)
