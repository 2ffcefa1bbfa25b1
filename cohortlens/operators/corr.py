"""Pairwise correlation, duplicate columns, correlation components and target matrices."""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions.text import numbered
from cohortlens.functions.numeric import finite, safe_corr
from cohortlens.operators.gram import residual_coefficients
from cohortlens.operators.ranks import value_ranks
from cohortlens.session import cut_lineage, measured


def _column_pairs(columns: Sequence[str]) -> list[tuple[str, str]]:
    return [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]


def pair_rows(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """(feature_1, feature_2, a, b): each row once per pair of columns, complete rows of that pair only."""
    values = df.select(*[finite(F.col(c)).alias(c) for c in columns])
    entries = [
        F.struct(F.lit(p).alias("feature_1"), F.lit(q).alias("feature_2"), F.col(p).alias("a"), F.col(q).alias("b"))
        for p, q in _column_pairs(list(columns))
    ]
    return values.select(F.explode(F.array(*entries)).alias("e")).select("e.*").filter(
        F.col("a").isNotNull() & F.col("b").isNotNull()
    )


def pairwise_correlations(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Spearman and Pearson of every column pair on its complete rows, and whether the columns are equal there."""
    keys = ["feature_1", "feature_2"]
    rows = pair_rows(df, columns)
    ranked = value_ranks(rows, keys, {"a": "ra", "b": "rb"})
    return ranked.groupBy(*keys).agg(
        safe_corr(F.col("ra"), F.col("rb")).alias("spearman_rho"),
        safe_corr(F.col("a"), F.col("b")).alias("pearson_r"),
        F.count(F.lit(1)).alias("n_complete"),
        F.bool_and(F.col("a") == F.col("b")).alias("is_exact_duplicate"),
    )


def rank_gram_correlations(df: DataFrame, columns: Sequence[str], key: str) -> DataFrame:
    """Spearman of every pair when no value is missing: each column is ranked once, pairs come from one aggregation."""
    long = df.select(key, *[finite(F.col(c)).alias(c) for c in columns]).unpivot([key], list(columns), "feature", "x")
    ranked = value_ranks(long, ["feature"], {"x": "r"})
    wide = ranked.groupBy(key).agg(*[F.max(F.when(F.col("feature") == c, F.col("r"))).alias(c) for c in columns])
    pairs = _column_pairs(list(columns))
    row = wide.agg(*[safe_corr(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    entries = [
        F.struct(F.lit(a).alias("feature_1"), F.lit(b).alias("feature_2"), F.col(f"_{i}").alias("spearman_rho"))
        for i, (a, b) in enumerate(pairs)
    ]
    return row.select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def high_pairs(pairs: DataFrame, threshold: float = 0.90) -> DataFrame:
    """Pairs whose |rho| lies strictly above the threshold."""
    return pairs.filter(F.abs("spearman_rho") > threshold).withColumn("abs_rho", F.abs("spearman_rho"))


def duplicate_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Column pairs equal in every row, missing values included, from one aggregation."""
    values = df.select(*[finite(F.col(c)).alias(c) for c in columns])
    pairs = _column_pairs(list(columns))
    aggs: list[Column] = []
    for i, (a, b) in enumerate(pairs):
        both = F.col(a).isNotNull() & F.col(b).isNotNull()
        aggs += [
            F.bool_and(F.col(a).eqNullSafe(F.col(b))).alias(f"_same{i}"),
            F.count_if(both).alias(f"_n{i}"),
            F.count_if(~both).alias(f"_m{i}"),
        ]
    entries = [
        F.struct(
            F.lit(a).alias("feature_1"),
            F.lit(b).alias("feature_2"),
            F.col(f"_same{i}").alias("is_same"),
            F.col(f"_n{i}").alias("n_complete"),
            F.col(f"_m{i}").alias("n_missing"),
        )
        for i, (a, b) in enumerate(pairs)
    ]
    table = values.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.*")
    return table.filter("is_same").drop("is_same")


def duplicate_policy_violations(duplicates: DataFrame, retain: str, drop: str) -> DataFrame:
    """Duplicate pairs other than the one that is declared."""
    declared = (F.least("feature_1", "feature_2") == min(retain, drop)) & (F.greatest("feature_1", "feature_2") == max(retain, drop))
    return duplicates.filter(~declared)


def connected_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label): the smallest node of each component.

    Each round takes the smallest label among neighbours and then follows the label's own label, so the
    number of rounds grows with the logarithm of a component's diameter in practice. Rounds are checkpointed.
    """
    links = edges.select(F.col("a").alias("node"), F.col("b").alias("other"))
    links = cut_lineage(links.unionByName(links.select(F.col("other").alias("node"), F.col("node").alias("other"))).distinct())
    labels = cut_lineage(nodes.select("node", F.col("node").alias("label")).distinct())
    while True:
        seen = labels.select(F.col("node").alias("other"), F.col("label").alias("other_label"))
        near = links.join(seen, "other").groupBy("node").agg(F.min("other_label").alias("low"))
        nearest = labels.join(near, "node", "left").select("node", "label", F.least("label", F.coalesce("low", "label")).alias("low"))
        jump = nearest.select(F.col("node").alias("low"), F.col("low").alias("next"))
        moved = cut_lineage(nearest.join(jump, "low", "left").select("node", "label", F.least("low", F.coalesce("next", "low")).alias("new")))
        labels = moved.select("node", F.col("new").alias("label"))
        if moved.filter(F.col("new") != F.col("label")).isEmpty():
            return labels


def name_components(labels: DataFrame) -> DataFrame:
    """(component_id, feature, component_size, members) with ids C01, C02, ... in order of the smallest member.

    Meant for graphs whose nodes are columns: the member list of a component is one text value.
    """
    grouped = labels.groupBy("label").agg(F.array_sort(F.collect_list("node")).alias("_members"))
    number = F.row_number().over(W.orderBy("label"))
    named = grouped.select(
        numbered("C", number, 2).alias("component_id"),
        F.size("_members").cast("bigint").alias("component_size"),
        F.concat_ws("|", "_members").alias("members"),
        F.col("_members"),
    )
    return named.select("component_id", F.explode("_members").alias("feature"), "component_size", "members")


def feature_components(df: DataFrame, columns: Sequence[str], threshold: float = 0.90) -> DataFrame:
    """Components of the graph of columns whose |rho| is strictly above the threshold."""
    edges = high_pairs(pairwise_correlations(df, columns), threshold)
    nodes = df.sparkSession.createDataFrame([(c,) for c in columns], "node string")
    return name_components(connected_components(nodes, edges.select(F.col("feature_1").alias("a"), F.col("feature_2").alias("b"))))


def train_centred(df: DataFrame, by: Sequence[str], stratum: str, y: str) -> DataFrame:
    """Adds y_centred = y minus the stratum mean of the other folds."""
    by = list(by)
    sums = df.groupBy(*by, "fold", stratum).agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    over = W.partitionBy(*by, stratum)
    means = sums.select(
        *by, "fold", stratum, F.try_divide(F.sum("_s").over(over) - F.col("_s"), F.sum("_n").over(over) - F.col("_n")).alias("_mean")
    )
    return df.join(measured(means), [*by, "fold", stratum]).withColumn("y_centred", F.col(y) - F.col("_mean")).drop("_mean")


def target_variants(targets: DataFrame, stratum: str, z: tuple[str, str]) -> DataFrame:
    """(cell_id, target, variant, value): raw, adjusted for two covariates and stratum-centred, all train-only."""
    coefficients = residual_coefficients(targets, ["target"], "y", z)
    adjusted = targets.join(coefficients, ["target", "fold"]).select(
        "cell_id",
        "target",
        F.lit("adjusted").alias("variant"),
        (F.col("y") - F.col("b0") - F.col("b1") * F.col(z[0]) - F.col("b2") * F.col(z[1])).alias("value"),
    )
    centred = train_centred(targets, ["target"], stratum, "y").select(
        "cell_id", "target", F.lit("stratum_centred").alias("variant"), F.col("y_centred").alias("value")
    )
    raw = targets.select("cell_id", "target", F.lit("raw").alias("variant"), F.col("y").alias("value"))
    return raw.unionByName(adjusted).unionByName(centred)


def target_correlations(variants: DataFrame, names: Sequence[str]) -> DataFrame:
    """(variant, target_1, target_2, rho) for every ordered pair of targets, the diagonal included."""
    ranked = value_ranks(variants, ["variant", "target"], {"value": "r"})
    wide = ranked.groupBy("variant", "cell_id").agg(*[F.max(F.when(F.col("target") == t, F.col("r"))).alias(t) for t in names])
    pairs = _column_pairs(list(names))
    rho = wide.groupBy("variant").agg(*[safe_corr(F.col(a), F.col(b)).alias(f"_{i}") for i, (a, b) in enumerate(pairs)])
    entries = [F.struct(F.lit(a).alias("target_1"), F.lit(a).alias("target_2"), F.lit(1.0).alias("rho")) for a in names]
    for i, (a, b) in enumerate(pairs):
        for p, q in ((a, b), (b, a)):
            entries.append(F.struct(F.lit(p).alias("target_1"), F.lit(q).alias("target_2"), F.col(f"_{i}").alias("rho")))
    return rho.select("variant", F.explode(F.array(*entries)).alias("e")).select("variant", "e.*")


def matrix_summary(matrix: DataFrame, by: Sequence[str], row: str, col: str, value: str) -> DataFrame:
    """Size, symmetry, unit diagonal and participation ratio from the trace identities: no eigenvalues needed."""
    by = list(by)
    a = matrix.select(*by, F.col(row).alias("_i"), F.col(col).alias("_j"), F.col(value).alias("_v"))
    flipped = a.select(*by, F.col("_j").alias("_i"), F.col("_i").alias("_j"), F.col("_v").alias("_w"))
    joined = a.join(flipped, [*by, "_i", "_j"], "left")
    trace = F.sum(F.when(F.col("_i") == F.col("_j"), F.col("_v")))
    return joined.groupBy(*by).agg(
        F.count_distinct("_i").alias("size"),
        F.max(F.coalesce(F.abs(F.col("_v") - F.col("_w")), F.lit(float("inf")))).alias("max_asymmetry"),
        F.max(F.when(F.col("_i") == F.col("_j"), F.abs(F.col("_v") - 1))).alias("max_diagonal_error"),
        F.try_divide(trace * trace, F.sum(F.col("_v") * F.col("_v"))).alias("participation_ratio"),
    )


def matrix_eigenvalues(matrix: DataFrame, by: str, row: str, col: str, value: str) -> DataFrame:
    """Descending eigenvalues of the small matrix of each key, first share and the shared-axis flag."""

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        square = pdf.pivot(index=row, columns=col, values=value).to_numpy(dtype=float)
        values = np.linalg.eigvalsh(square)[::-1]
        share = float(values[0] / len(square))
        return pd.DataFrame(
            {
                by: pdf[by].iloc[0],
                "position": np.arange(1, len(values) + 1),
                "eigenvalue": values,
                "first_fraction": share,
                "shared_axis": share >= 0.5,
            }
        )

    return matrix.groupBy(by).applyInPandas(
        solve, f"{by} string, position int, eigenvalue double, first_fraction double, shared_axis boolean"
    )
