"""Column profiles, feature dictionaries and cohort summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numeric import finite
from cohortlens.operators.ranks import exact_quantiles, top_k


def column_profile(df: DataFrame, columns: Sequence[str], top: int = 20) -> DataFrame:
    """Per column: missing, distinct values, the most frequent values as JSON text, and of numbers the exact quartiles.

    Values are stacked as text and counted once per (column, value); everything else derives from those counts.
    """
    kinds = dict(df.select(*columns).dtypes)
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counted = long.groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    present = counted.filter(F.col("value").isNotNull())
    totals = counted.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_distinct"),
    )
    best = top_k(present, ["column"], [F.desc("n"), F.col("value")], top, "_rn")
    tops = best.groupBy("column").agg(
        F.to_json(
            F.map_from_entries(F.transform(F.array_sort(F.collect_list(F.struct("_rn", "value", "n"))), lambda s: F.struct(s["value"], s["n"])))
        ).alias("top_values")
    )
    numbers = [c for c, t in kinds.items() if t.split("(")[0] in ("tinyint", "smallint", "int", "bigint", "float", "double", "decimal")]
    values = present.filter(F.col("column").isin(numbers)).select("column", finite(F.col("value").cast("double")).alias("x"), "n").filter(F.col("x").isNotNull())
    spread = exact_quantiles(values, ["column"], "x", {"min": 0.0, "q1": 0.25, "median": 0.5, "q3": 0.75, "max": 1.0}, weight="n").drop("n")
    kind = F.create_map(*[F.lit(x) for item in kinds.items() for x in item])
    return (
        totals.join(tops, "column", "left")
        .join(spread, "column", "left")
        .withColumn("dtype", F.element_at(kind, F.col("column")))
        .withColumn("missing_fraction", F.try_divide(F.col("n_missing").cast("double"), F.col("n_rows")))
    )


def top_values(df: DataFrame, columns: Sequence[str], k: int = 20) -> DataFrame:
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "column", "value")
    counted = long.filter(F.col("value").isNotNull()).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))
    return top_k(counted, ["column"], [F.desc("n"), F.col("value")], k)


def numeric_profile(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Per column: count, missing, mean, sample SD, minimum, exact quartiles and maximum."""
    long = df.select(*[finite(F.col(c)).alias(c) for c in columns]).unpivot([], list(columns), "feature", "x")
    quartiles = exact_quantiles(long, ["feature"], "x", {"q1": 0.25, "median": 0.5, "q3": 0.75}).drop("n")
    stats = long.groupBy("feature").agg(
        F.count("x").alias("n"),
        F.count_if(F.col("x").isNull()).alias("n_missing"),
        F.avg("x").alias("mean"),
        F.stddev_samp("x").alias("sd"),
        F.min("x").alias("min"),
        F.max("x").alias("max"),
    )
    return stats.join(quartiles, "feature", "left")


def feature_dictionary(df: DataFrame, features: Sequence[str], scales: DataFrame, bound: float = 6.0) -> DataFrame:
    """Per feature: missing values, stored centre and scale, and values at the clipping boundary."""
    long = df.select(*[F.col(c).cast("double").alias(c) for c in features]).unpivot([], list(features), "feature", "z")
    counts = long.groupBy("feature").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(finite(F.col("z")).isNull()).alias("n_missing"),
        F.count_if(F.col("z") == bound).alias("n_at_upper"),
        F.count_if(F.col("z") == -bound).alias("n_at_lower"),
    )
    return counts.join(scales, "feature", "left")


def cohort_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Value counts of several categorical columns in one pass."""
    long = df.select(*[F.col(c).cast("string").alias(c) for c in columns]).unpivot([], list(columns), "characteristic", "level")
    counts = long.groupBy("characteristic", "level").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("characteristic").agg(F.sum("n").alias("_all"))
    return counts.join(totals, "characteristic").select(
        "characteristic", F.coalesce("level", F.lit("missing")).alias("level"), "n", (F.col("n") / F.col("_all")).alias("share")
    )


def disagreement_counts(df: DataFrame, a: str, b: str) -> DataFrame:
    """How often each pair of differing labels occurs; rows lacking a label are left out."""
    return (
        df.filter(F.col(a).isNotNull() & F.col(b).isNotNull() & (F.col(a) != F.col(b)))
        .groupBy(a, b)
        .agg(F.count(F.lit(1)).alias("n"))
    )


def reconciliation_with_total(df: DataFrame, by: str, n_cells, n_sum) -> DataFrame:
    """One row per key and a grand total named ALL."""
    rolled = df.rollup(by).agg(F.count(F.lit(1)).alias("n"), F.sum(n_sum).alias("total"), F.grouping(by).alias("_g"))
    return rolled.withColumn(by, F.when(F.col("_g") == 1, "ALL").otherwise(F.col(by).cast("string"))).drop("_g")
