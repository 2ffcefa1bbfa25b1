"""Helpers shared by the text operators: tables, scratch tables in the shared folder, positions."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

#: What separates words everywhere in this package: blank, tab, line ends.
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_path(spark: SparkSession, name: str) -> str:
    """A new folder that driver and executors share; only a local session without a setting gets one of its own."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if base is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder every executor can reach")
        base = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def written(df: DataFrame, name: str, compression: str = "snappy") -> DataFrame:
    """The rows as a table in the shared folder: cuts lineage, survives lost executors, is read column by column."""
    spark, path = df.sparkSession, shared_path(df.sparkSession, name)
    df.write.parquet(path, compression=compression)
    return spark.read.schema(df.schema).parquet(path)


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def size(text: Column) -> Column:
    """Number of words; null counts as 0."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("bigint")


def positions(df: DataFrame, order: list[Column], out: str) -> DataFrame:
    """0-based position of each row in one order of all rows, without a window over all of them.

    Rows are dealt out by range, the partition numbers are written down, and only one count per partition meets in
    a single window.
    """
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), *order).withColumn("_part", F.spark_partition_id())
    dealt = written(dealt, "positions")
    before = dealt.groupBy("_part").count().select(
        "_part", (F.sum("count").over(W.orderBy("_part")) - F.col("count")).alias("_before")
    )
    inside = F.row_number().over(W.partitionBy("_part").orderBy(*order)) - 1
    return dealt.join(before, "_part").withColumn(out, F.col("_before") + inside).drop("_part", "_before")
