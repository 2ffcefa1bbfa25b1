"""Count QC kept up to date as count files arrive."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

COUNTS = "sample_id string, gene string, cnt bigint"


def count_stream(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    return spark.readStream.schema(COUNTS).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def once(counts: DataFrame) -> DataFrame:
    """Each (sample, gene) cell the first time it arrives: a file that is delivered again counts once.

    State is the key of every cell seen, spread over the executors by key.
    """
    return counts.dropDuplicates(["sample_id", "gene"])


def running_sample_totals(counts: DataFrame) -> DataFrame:
    """Totals and detected genes per sample. State is one row per sample; each (sample, gene) cell arrives once."""
    return counts.groupBy("sample_id").agg(
        F.sum("cnt").alias("total_counts"), F.count_if(F.col("cnt") > 0).alias("genes_detected")
    )


def running_gene_counts(counts: DataFrame) -> DataFrame:
    """Detection and count moments per gene."""
    return counts.groupBy("gene").agg(
        F.count_if(F.col("cnt") > 0).alias("detected_n"),
        F.sum("cnt").alias("total_counts"),
        F.sum(F.col("cnt") * F.col("cnt")).alias("sum_squares"),
    )


def start(aggregated: DataFrame, name: str, checkpoint: str) -> StreamingQuery:
    """Runs what is available to an in-memory table; production code swaps in a table sink."""
    return (
        aggregated.writeStream.outputMode("complete")
        .format("memory")
        .queryName(name)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start()
    )


def start_table(aggregated: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Runs what is available and writes the rows each batch changed to a folder of its own in path.

    A batch that is repeated after a failure writes its own folder anew, so nothing counts twice, and no more than the
    changed rows are written; no table is kept in the driver.
    """

    def write(changed: DataFrame, batch: int) -> None:
        changed.write.mode("overwrite").parquet(f"{path}/batch={batch}")

    stream = aggregated.writeStream.outputMode("update").foreachBatch(write)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current(spark: SparkSession, path: str, keys: Sequence[str]) -> DataFrame:
    """The newest row of each key in a table of start_table."""
    rows = spark.read.parquet(path)
    rest = [c for c in rows.columns if c not in (*keys, "batch")]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("_now")).select(*keys, "_now.*")
