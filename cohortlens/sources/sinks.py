"""Partitioned fact sinks. Spark's commit protocol makes each write all-or-nothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_partitions(df: DataFrame, path: str, by: Sequence[str] = ("module",), spread: int = 1) -> None:
    """Replaces only the partitions present in df; a hot partition is written by `spread` tasks."""
    placed = df.repartition(*by, F.pmod(F.xxhash64(*df.columns), F.lit(spread))) if spread > 1 else df.repartition(*by)
    placed.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(*by).parquet(path)


def append_batch(df: DataFrame, path: str, by: Sequence[str] = ("module",)) -> None:
    """Adds one finished batch of units, so a stopped run keeps what it has."""
    df.write.mode("append").partitionBy(*by).parquet(path)


def write_table(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    writer = df.write.mode("overwrite")
    (writer.option("header", True) if fmt == "csv" else writer).format(fmt).save(path)
