"""Session helpers: tests' local session, checkpoint folder, table reader."""

from __future__ import annotations

import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def local_session(cores: int = 4, shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A local session for tests and ``bench.py``; on a cluster the session comes from outside."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName("gridloom")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", os.environ.get("GRIDLOOM_DRIVER_MEMORY", "8g"))
    )
    for key, value in conf.items():
        builder = builder.config(key, value)
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder of the cluster (``spark.checkpoint.dir``); a temporary one only where it is unset and Spark runs in this process alone."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        current = spark.sparkContext._jsc.sc().getCheckpointDir()
        if current.isDefined():
            folder = current.get()
        elif is_local(spark.sparkContext.master):
            folder = f"file://{tempfile.mkdtemp(prefix='gridloom-')}"
        else:
            raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    if not spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        spark.sparkContext.setCheckpointDir(folder)
    return folder


def is_local(master: str) -> bool:
    """Whether driver and executors are one process and so see the same disk."""
    return master == "local" or master.startswith("local[")


def table(spark: SparkSession, directory: str, name: str) -> DataFrame:
    """Reads one of the named Parquet tables of a data directory."""
    return spark.read.parquet(f"{directory}/{name}.parquet")


def stored(df: DataFrame, name: str = "stored") -> DataFrame:
    """The table written to the shared folder and read again: computed once, a short plan, and safe when executors are lost."""
    path = f"{checkpoint_dir(df.sparkSession)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def spread(df: DataFrame) -> DataFrame:
    """Rows over all cores where the input has fewer splits than that; each split is bounded, so little is moved. Else unchanged."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
