"""Scans: repaired CSV headers, keyed Parquet, wide counts, JSON control sets, module definitions, manifests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

ACCESSION = r"^CS[0-9]+$"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tail_shape(df: DataFrame, accession: str, label: str) -> DataFrame:
    """One row: whether all accession values look like accessions and no label does."""
    return df.agg(
        F.coalesce(F.bool_and(F.col(accession).rlike(ACCESSION)), F.lit(True)).alias("accessions_ok"),
        F.coalesce(~F.bool_or(F.col(label).rlike(ACCESSION)), F.lit(False)).alias("labels_ok"),
    )


def repair_tail(df: DataFrame, accession: str, label: str) -> DataFrame:
    """Renames the two malformed tail columns once their values prove what they hold."""
    shape = tail_shape(df, accession, label).first()
    if not (shape["accessions_ok"] and shape["labels_ok"]):
        raise ValueError(f"cannot interpret {accession!r} and {label!r}: {shape.asDict()}")
    return df.withColumnRenamed(accession, "cluster_id").withColumnRenamed(label, "cluster_label")


def read_metadata(spark: SparkSession, path: str, schema: T.StructType, accession: str, label: str) -> DataFrame:
    return repair_tail(spark.read.csv(path, header=True, schema=schema, enforceSchema=True), accession, label)


def identifier_column(df: DataFrame, candidates: Sequence[str]) -> str:
    for name in candidates:
        if name in df.columns:
            return name
    raise ValueError(f"none of {list(candidates)} among {df.columns}")


def read_keyed_parquet(spark: SparkSession, path: str, candidates: Sequence[str], out: str = "cell_id") -> tuple[DataFrame, DataFrame]:
    """The table with its identifier as text under one name, and any repeated identifiers."""
    df = spark.read.parquet(path)
    key = identifier_column(df, candidates)
    keyed = df.withColumnRenamed(key, out).withColumn(out, F.col(out).cast("string"))
    return keyed, keyed.groupBy(out).agg(F.count(F.lit(1)).alias("n")).filter("n > 1")


def wide_to_long(wide: DataFrame, gene: str, samples: Sequence[str]) -> DataFrame:
    """(gene, sample_id, cnt) without zeros from a genes-by-samples matrix."""
    long = wide.unpivot([gene], list(samples), "sample_id", "cnt")
    return long.select(F.col(gene).alias("gene"), "sample_id", F.col("cnt").cast("bigint").alias("cnt")).filter("cnt > 0")


def invalid_counts(wide: DataFrame, gene: str, samples: Sequence[str]) -> DataFrame:
    """Cells that are missing, negative or not whole."""
    long = wide.unpivot([gene], list(samples), "sample_id", "cnt")
    value = F.col("cnt").cast("double")
    return long.filter(value.isNull() | F.isnan(value) | (value < 0) | (value != F.floor(value)))


def selected_and_totals(long: DataFrame, requested: DataFrame) -> DataFrame:
    """(sample_id, gene, cnt, total): requested genes only, with totals taken over all genes in the same scan.

    One grouping by (sample, requested gene or none) leaves a few rows per sample, from which totals follow.
    """
    marked = long.join(requested.select("gene").distinct().withColumn("_hit", F.lit(True)), "gene", "left")
    kept = F.when(F.col("_hit"), F.col("gene"))
    sums = marked.groupBy("sample_id", kept.alias("gene")).agg(F.sum("cnt").alias("cnt"))
    totals = sums.groupBy("sample_id").agg(F.sum("cnt").alias("total"))
    return sums.filter(F.col("gene").isNotNull()).join(totals, "sample_id")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Tab-separated (path, bytes, sha256)."""
    return spark.read.csv(path, sep="\t", header=True, schema="path string, bytes bigint, sha256 string")


CONTROL_JSON = T.StructType(
    [
        T.StructField("module", T.StringType()),
        T.StructField(
            "controls",
            T.ArrayType(
                T.StructType(
                    [T.StructField("control_id", T.IntegerType()), T.StructField("genes", T.ArrayType(T.StringType()))]
                )
            ),
        ),
    ]
)


def read_control_sets(spark: SparkSession, path: str) -> DataFrame:
    return flatten_control_sets(spark.read.json(path, schema=CONTROL_JSON, multiLine=True))


def flatten_control_sets(nested: DataFrame) -> DataFrame:
    """(module, control_id, gene, weight, expected_n) from nested control sets; weight is 1/size."""
    sets = nested.select("module", F.explode("controls").alias("c")).select("module", "c.control_id", "c.genes")
    n = F.size("genes")
    return sets.select(
        "module", "control_id", F.explode("genes").alias("gene"), (F.lit(1.0) / n).alias("weight"), n.cast("bigint").alias("expected_n")
    )


def module_membership(definitions: DataFrame) -> DataFrame:
    """(module, gene, ordinal) from (module, genes array)."""
    return definitions.select("module", F.posexplode("genes").alias("ordinal", "gene")).select(
        "module", F.trim("gene").alias("gene"), "ordinal"
    )


def module_issues(membership: DataFrame, expected: Sequence[str] | None = None) -> DataFrame:
    """(module, gene, issue): empty or repeated symbols and unexpected module names."""
    empty = membership.filter(F.length("gene") == 0).select("module", "gene", F.lit("empty").alias("issue"))
    repeated = (
        membership.groupBy("module", "gene").agg(F.count(F.lit(1)).alias("n")).filter("n > 1")
        .select("module", "gene", F.lit("repeated").alias("issue"))
    )
    out = empty.unionByName(repeated)
    if expected is not None:
        foreign = membership.filter(~F.col("module").isin(*expected)).select("module", F.lit("").alias("gene"), F.lit("unexpected_module").alias("issue")).distinct()
        out = out.unionByName(foreign)
    return out
