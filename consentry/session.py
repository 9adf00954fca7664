"""Session settings and durable lineage cuts."""

from __future__ import annotations

import logging
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def build_session(
    app: str = "consentry",
    cores: int | str = "*",
    shuffle_partitions: int | None = None,
) -> SparkSession:
    """A local session for tests and benchmarks; a cluster brings its own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]")
        .appName(app)
        .config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.driver.memory", os.environ.get("SPARK_DRIVER_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions or 8))
    )
    spark = builder.getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    for name in ("SQLQueryContextLogger", "DataFrameQueryContextLogger"):
        logging.getLogger(name).setLevel(logging.CRITICAL)
    return spark


def scratch_root(spark: SparkSession) -> str:
    """Shared folder for checkpoints and intermediate tables.

    A cluster names it in ``spark.checkpoint.dir``. Only a local master may
    fall back to a folder of this machine.
    """
    sc = spark.sparkContext
    root = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not root:
        if not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder all executors can reach")
        root = sc.getCheckpointDir() or tempfile.mkdtemp(prefix="consentry-")
    if sc.getCheckpointDir() is None:
        sc.setCheckpointDir(root)
    return root


def scratch_path(spark: SparkSession, label: str) -> str:
    return f"{scratch_root(spark).rstrip('/')}/{label}-{uuid.uuid4().hex}"


def durable(df: DataFrame, label: str = "cut") -> DataFrame:
    """Writes a frame to the shared folder and reads it back.

    The plan behind it is cut, a lost executor repeats nothing, and the next joins plan
    with the real size of the files.
    """
    path = scratch_path(df.sparkSession, label)
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._scratch = path
    return out


def release(df: DataFrame) -> None:
    """Deletes the files of a frame that ``durable`` returned. Nothing that is still to run may read it."""
    path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._scratch)
    path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def checked_broadcast(df: DataFrame, max_rows: int = 1_000_000) -> DataFrame:
    """A broadcast hint for a frame that was counted and found small; else the frame.

    ``df`` should be cheap to count, such as the result of ``durable``.
    """
    small = df.limit(max_rows + 1).count() <= max_rows
    return F.broadcast(df) if small else df


def spread(df: DataFrame) -> DataFrame:
    """Shares costly row work among all cores when the files give too few splits.

    A table with at least as many splits as cores is left alone, so nothing big moves.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df.repartition(cores) if df.rdd.getNumPartitions() < cores else df
