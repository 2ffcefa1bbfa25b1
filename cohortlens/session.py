"""Session helpers: settings we rely on and lineage cutting that survives executor loss."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def build_session(master: str = "local[*]", shuffle_partitions: int = 8, **conf: str) -> SparkSession:
    """A session with the settings the library is written for; cluster values win when given."""
    builder = (
        SparkSession.builder.master(master)
        .appName("cohortlens")
        .config("spark.sql.shuffle.partitions", str(shuffle_partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.sql.execution.arrow.pyspark.enabled", "true")
        .config("spark.ui.enabled", "false")
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def _checkpoint_dir(spark: SparkSession) -> None:
    context = spark.sparkContext
    if context.getCheckpointDir() is not None:
        return
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if shared is None:
        if not context.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        shared = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    context.setCheckpointDir(shared)


def cut_lineage(df: DataFrame, eager: bool = True) -> DataFrame:
    """Reliable checkpoint in the cluster's shared folder; used between rounds of iterative jobs."""
    _checkpoint_dir(df.sparkSession)
    return df.checkpoint(eager=eager)


def measured(df: DataFrame) -> DataFrame:
    """The table written to the shared folder and read back, so that Spark plans with the size it has.

    Rows that meet a small one then stay where they are: without a size Spark moves every row to its key first, and a
    handful of keys is a handful of tasks. A large table is joined by a shuffle as before; nothing is forced.
    """
    spark = df.sparkSession
    _checkpoint_dir(spark)
    path = f"{spark.sparkContext.getCheckpointDir()}/measured-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.parquet(path)


def bucket_count(df: DataFrame, ceiling: int = 1024) -> int:
    """How many value ranges a hot group is cut into: follows the cluster's shuffle width."""
    width = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return max(4, min(ceiling, width))
