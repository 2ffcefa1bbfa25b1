"""Group-disjoint folds, inner splits, subsets and the leakage ledger."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions.rng import hash32
from cohortlens.operators.ranks import ordered_index


def hash_folds(df: DataFrame, group: str, k: int, seed: int = 42, out: str = "fold") -> DataFrame:
    """Fold from the group's hash alone: no shuffle, and new rows of a group keep its fold."""
    return df.withColumn(out, F.pmod(hash32(seed, F.col(group)), F.lit(k)).cast("int"))


def _serpentine(position: Column, k: int) -> Column:
    lap, step = F.floor(position / k), F.pmod(position, F.lit(k))
    return F.when(lap % 2 == 0, step).otherwise(k - 1 - step).cast("int")


def group_profile(df: DataFrame, group: str, stratum: str) -> DataFrame:
    """Per group its size and dominant stratum (largest count, then smallest name)."""
    counts = df.groupBy(group, stratum).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(group).agg(
        F.sum("_n").alias("n_cells"),
        F.min(F.struct((-F.col("_n")).alias("neg"), F.col(stratum).alias("stratum"))).alias("_top"),
    ).select(group, "n_cells", F.col("_top.stratum").alias("dominant"))


def _size_then_hash(n: Column, *parts) -> Column:
    return -(n.cast("bigint") * F.lit(4294967296)) + hash32(*parts)


def stratified_group_folds(df: DataFrame, group: str, stratum: str, k: int, seed: int = 42) -> DataFrame:
    """(group, n_cells, dominant, fold): groups of one dominant stratum dealt out largest first, back and forth."""
    profile = group_profile(df, group, stratum)
    placed = ordered_index(
        profile, ["dominant"], _size_then_hash(F.col("n_cells"), seed, F.col(group)), [group], "_pos"
    )
    return placed.withColumn("fold", _serpentine(F.col("_pos"), k)).drop("_pos")


def repeated_group_folds(df: DataFrame, group: str, stratum: str, k: int, seeds: Sequence[int]) -> DataFrame:
    """One fold per (repeat_seed, group) for several seeds from one pass over the rows."""
    profile = group_profile(df, group, stratum).withColumn("repeat_seed", F.explode(F.array(*map(F.lit, seeds))))
    placed = ordered_index(
        profile,
        ["repeat_seed", "dominant"],
        _size_then_hash(F.col("n_cells"), F.col("repeat_seed"), F.col(group)),
        [group],
        "_pos",
    )
    return placed.withColumn("fold", _serpentine(F.col("_pos"), k)).drop("_pos")


def size_balanced_folds(df: DataFrame, by: Sequence[str], group: str, k: int) -> DataFrame:
    """Groups dealt out by descending size within by: fold sizes differ by at most one large group."""
    sizes = df.groupBy(*by, group).agg(F.count(F.lit(1)).alias("n_cells"))
    placed = ordered_index(sizes, by, _size_then_hash(F.col("n_cells"), "size", F.col(group)), [group], "_pos")
    return placed.withColumn("fold", _serpentine(F.col("_pos"), k)).drop("_pos")


def outer_views(df: DataFrame, folds: Sequence[int], fold: str = "fold") -> DataFrame:
    """Every row once per outer fold, marked train or test."""
    return df.withColumn("outer_fold", F.explode(F.array(*[F.lit(f) for f in folds]))).withColumn(
        "is_test", F.col(fold) == F.col("outer_fold")
    )


def inner_group_split(df: DataFrame, group: str, folds: Sequence[int], share: float = 0.2, seed: int = 42) -> DataFrame:
    """(outer_fold, group, is_validation) over training groups: ceil(share*G) groups validate."""
    groups = outer_views(df.select(group, "fold").distinct(), folds).filter(~F.col("is_test"))
    placed = ordered_index(
        groups.select("outer_fold", group),
        ["outer_fold"],
        hash32(seed, F.col("outer_fold"), F.col(group)),
        [group],
        "_pos",
        "_groups",
        hashed=True,
    )
    return placed.select(
        "outer_fold", group, (F.col("_pos") < F.ceil(F.lit(share) * F.col("_groups"))).alias("is_validation")
    )


def inner_validation_mask(df: DataFrame, group: str, folds: Sequence[int], share: float = 0.2, seed: int = 42) -> DataFrame:
    """Per group a bit mask: bit k is set where the group validates inside outer fold k."""
    split = inner_group_split(df, group, folds, share, seed)
    bit = F.when(F.col("is_validation"), F.pow(F.lit(2), F.col("outer_fold")).cast("int"))
    return split.groupBy(group).agg(F.coalesce(F.sum(bit), F.lit(0)).cast("int").alias("mask"))


def fixed_subset(df: DataFrame, by: Sequence[str], key: str, k: int, seed: int = 42, out: str = "subset_rank") -> DataFrame:
    """k ids per by-key chosen by hash before any outcome is seen."""
    order = W.partitionBy(*by).orderBy(hash32(seed, *[F.col(c) for c in by], F.col(key)), key)
    return df.withColumn(out, F.row_number().over(order)).filter(F.col(out) <= k)


def fold_composition(df: DataFrame, stratum: str, folds: Sequence[int]) -> DataFrame:
    """Rows per fold and stratum, zero cells included, with each share's distance from the overall share."""
    counts = df.groupBy("fold", stratum).agg(F.count(F.lit(1)).alias("n"))
    overall = counts.groupBy(stratum).agg(F.sum("n").alias("_all"))
    grid = overall.withColumn("fold", F.explode(F.array(*[F.lit(f).cast("int") for f in folds])))
    cells = grid.join(counts, ["fold", stratum], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    fold_n = F.sum("n").over(W.partitionBy("fold"))
    total = F.sum("n").over(W.partitionBy())
    return cells.withColumn("proportion", F.try_divide(F.col("n").cast("double"), fold_n)).withColumn(
        "deviation", F.col("proportion") - F.try_divide(F.col("_all").cast("double"), total)
    ).drop("_all")


def leakage_ledger(df: DataFrame, folds: Sequence[int], cell: str = "cell_id", group: str = "group_id") -> DataFrame:
    """Per outer fold: rows and groups on each side, shared groups, and a digest of each side's ids.

    The digest is the sum of 32-bit id hashes, so it needs no sorted list of ids in one place.
    """
    views = outer_views(df.select(cell, group, "fold"), folds)
    rows = views.groupBy("outer_fold").agg(
        F.count_if(~F.col("is_test")).alias("train_n"),
        F.count_if(F.col("is_test")).alias("test_n"),
        F.sum(F.when(~F.col("is_test"), hash32(F.col(cell)))).alias("train_id_digest"),
        F.sum(F.when(F.col("is_test"), hash32(F.col(cell)))).alias("test_id_digest"),
    )
    sides = views.groupBy("outer_fold", group).agg(
        F.max(F.when(~F.col("is_test"), 1).otherwise(0)).alias("_train"),
        F.max(F.when(F.col("is_test"), 1).otherwise(0)).alias("_test"),
    )
    shared = sides.groupBy("outer_fold").agg(
        F.sum("_train").alias("train_groups"),
        F.sum("_test").alias("test_groups"),
        F.sum(F.col("_train") * F.col("_test")).alias("group_overlap"),
    )
    return rows.join(shared, "outer_fold").withColumn("fit_scope", F.lit("outer_training_only"))


def stratum_eligibility(df: DataFrame, stratum: str, group: str, min_cells: int, min_groups: int, top: int = 2) -> DataFrame:
    """Which strata are large enough to be analysed on their own."""
    counts = df.groupBy(stratum).agg(
        F.count(F.lit(1)).alias("n_cells"), F.count_distinct(group).alias("n_groups")
    )
    enough_cells, enough_groups = F.col("n_cells") >= min_cells, F.col("n_groups") >= min_groups
    return counts.select(
        stratum,
        "n_cells",
        "n_groups",
        (enough_cells & enough_groups).alias("eligible"),
        F.rank().over(W.orderBy(F.desc("n_cells"))).alias("cell_rank"),
        F.when(~enough_cells, "below_cell_threshold").when(~enough_groups, "below_group_threshold").otherwise("").alias(
            "exclusion_reason"
        ),
        (F.row_number().over(W.orderBy(F.desc("n_cells"), stratum)) <= top).alias("is_top"),
    )
