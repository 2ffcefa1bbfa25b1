"""Split-half reliability of gene sets: balanced partitions, half scores and Spearman-Brown."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions.numeric import choose, reliability_ratio, spearman_brown
from cohortlens.functions.rng import hash32
from cohortlens.functions.text import set_signature
from cohortlens.operators.blocks import set_products
from cohortlens.operators.metrics import observed_percentile
from cohortlens.operators.rankcorr import spearman
from cohortlens.session import cut_lineage

def set_sizes(sets: DataFrame, by: Sequence[str]) -> DataFrame:
    """Members per set, how many balanced splits exist and the set's signature."""
    n = F.col("gene_n")
    sizes = sets.groupBy(*by).agg(
        F.count(F.lit(1)).alias("gene_n"), set_signature(F.collect_list("gene")).alias("set_signature")
    )
    half = F.floor(n / 2).cast("bigint")
    ways = choose(n, half)
    return sizes.withColumn("max_partitions", F.when(n % 2 == 0, F.floor(ways / 2).cast("bigint")).otherwise(ways))


def balanced_partitions(sizes: DataFrame, by: Sequence[str], maximum: int, seed: int = 42) -> DataFrame:
    """(by, gene_n, max_partitions, mask, method): left halves of the sorted members, at most `maximum` per set.

    mask is text with one character per member, '1' for the left half; of an even set's mirrored pair only the
    one that holds the first member is kept. A set with at most `maximum` splits has all of them (it is short: an
    enumeration takes a few times `maximum` rows). Any other set draws hash-ordered halves until `maximum` different
    ones are found; sets that lack some draw twice as many again.
    """
    by = list(by)
    n = F.col("gene_n")
    few = F.coalesce(F.col("max_partitions").between(0, maximum), F.lit(False))  # null: more than a whole number holds
    small = sizes.filter(few).withColumn("_m", F.expr("explode(sequence(0L, shiftleft(1L, cast(gene_n as int)) - 1))"))
    canonical = (n % 2 == 1) | (F.expr("getbit(_m, 0)") == 1)
    halves = small.filter((F.bit_count("_m") == F.floor(n / 2)) & canonical).withColumn(
        "mask", F.expr("reverse(lpad(bin(_m), cast(gene_n as int), '0'))")
    )
    found = halves.select(*by, "gene_n", "max_partitions", "mask", F.lit("exhaustive").alias("method"))
    pending, draws = cut_lineage(sizes.filter(~few)), 2 * maximum
    while not pending.isEmpty():
        drawn = _first_masks(pending, by, draws, maximum, seed)
        full = cut_lineage(drawn.withColumn("_found", F.count(F.lit(1)).over(W.partitionBy(*by))).filter(F.col("_found") == maximum).drop("_found"))
        found = found.unionByName(full.withColumn("method", F.lit("deterministic_random_unique")))
        pending, draws = cut_lineage(pending.join(full.select(*by).distinct(), by, "left_anti")), 2 * draws
    return found


def _first_masks(sizes: DataFrame, by: list[str], draws: int, maximum: int, seed: int) -> DataFrame:
    """The first `maximum` different masks among a set's numbered draws."""
    n = F.col("gene_n")
    each = sizes.withColumn("_draw", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))
    members = F.sequence(F.lit(0).cast("bigint"), n - 1)
    order = F.array_sort(
        F.transform(
            members, lambda i: F.struct(hash32(seed, *[F.col(c) for c in by], F.col("_draw"), i).alias("h"), i.alias("i"))
        )
    )
    drawn = each.withColumn("_left", F.transform(F.slice(order, F.lit(1), F.floor(n / 2).cast("int")), lambda s: s["i"]))
    marks = F.transform(members, lambda i: F.when(F.array_contains(F.col("_left"), i), "1").otherwise("0"))
    drawn = drawn.withColumn("mask", F.array_join(marks, ""))
    mirrored = (n % 2 == 0) & F.col("mask").startswith("0")
    drawn = drawn.withColumn("mask", F.when(mirrored, F.translate("mask", "01", "10")).otherwise(F.col("mask")))
    first = drawn.groupBy(*by, "gene_n", "max_partitions", "mask").agg(F.min("_draw").alias("_draw"))
    rank = F.row_number().over(W.partitionBy(*by).orderBy("_draw"))
    return first.withColumn("_rank", rank).filter(F.col("_rank") <= maximum).drop("_rank", "_draw")


def _single(expression: DataFrame) -> DataFrame:
    """Single-precision values, whose sums in double are exact in any order."""
    return expression.select("sample_id", "gene", F.col("x").cast("float").cast("double").alias("x"))


def half_scores(expression: DataFrame, sets: DataFrame, partitions: DataFrame, samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, mask, sample_id, a, b): mean of each half per sample and partition; each partition is a weighted set of its own."""
    by = list(by)
    place = sets.withColumn("_i", F.row_number().over(W.partitionBy(*by).orderBy("gene")))
    inside = (F.substr(F.col("mask"), F.col("_i"), F.lit(1)) == "1").cast("double")
    weighted = place.join(partitions, by).select(*by, "mask", "gene_n", "gene", inside.alias("_left"), F.lit(1.0).alias("_all"))
    sums = set_products(_single(expression), samples, weighted, [*by, "mask", "gene_n"], ["_left", "_all"])
    left_n = F.floor(F.col("gene_n") / 2)
    # the sums are exact, so the right half is the rest
    return sums.select(
        *by,
        "mask",
        "sample_id",
        F.try_divide(F.col("_left"), left_n).alias("a"),
        F.try_divide(F.col("_all") - F.col("_left"), F.col("gene_n") - left_n).alias("b"),
    )


def set_spread(expression: DataFrame, sets: DataFrame, samples: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, genes, set_signature, score_variance): members, their digest, and the variance of the mean score over the samples."""
    by = list(by)
    sums = set_products(_single(expression), samples, sets.withColumn("_y", F.lit(1.0)), by, ["_y"])
    names = F.array_sort(F.collect_list("gene"))  # a set is short
    members = sets.groupBy(*by).agg(F.concat_ws("|", names).alias("genes"), set_signature(F.collect_list("gene")).alias("set_signature"), F.count("gene").alias("_n"))
    spread = sums.join(members, by).groupBy(*by, "genes", "set_signature").agg(F.var_pop(F.col("_y") / F.col("_n")).alias("score_variance"))
    return spread


def split_half_table(halves: DataFrame, partitions: DataFrame, by: Sequence[str]) -> DataFrame:
    """(by, mask, rho, sb) per partition."""
    keys = [*by, "mask"]
    rho = partitions.select(*keys).join(spearman(halves, keys, "a", "b", partitions).select(*keys, "rho"), keys, "left")
    return rho.withColumn("sb", spearman_brown(F.col("rho")))


def split_half_summary(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """Quartiles over the partitions of a set (a bounded number per set)."""
    probs = F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))
    stats = table.groupBy(*by).agg(
        F.count(F.lit(1)).alias("partition_n"),
        F.percentile("rho", probs).alias("_r"),
        F.percentile("sb", probs).alias("_s"),
        F.min("rho").alias("min_rho"),
        F.max("rho").alias("max_rho"),
        F.min("sb").alias("min_sb"),
        F.max("sb").alias("max_sb"),
    )
    return stats.select(
        *by,
        "partition_n",
        *[F.col("_r")[i].alias(f"{q}_rho") for i, q in enumerate(("q1", "median", "q3"))],
        *[F.col("_s")[i].alias(f"{q}_sb") for i, q in enumerate(("q1", "median", "q3"))],
        "min_rho",
        "max_rho",
        "min_sb",
        "max_sb",
    )


def reliability(expression: DataFrame, sets: DataFrame, samples: DataFrame, by: Sequence[str], maximum: int, seed: int = 42) -> DataFrame:
    """The whole chain for any number of sets: partitions, half scores, correlations, quartiles."""
    sizes = set_sizes(sets, by)
    partitions = cut_lineage(balanced_partitions(sizes, by, maximum, seed))
    table = split_half_table(half_scores(expression, sets, partitions, samples, by), partitions, by)
    kinds = partitions.select(*by, "gene_n", "max_partitions", "method").distinct()
    return split_half_summary(table, by).join(kinds, list(by)).join(set_spread(expression, sets, samples, by), list(by))


def reliability_percentile(controls: DataFrame, observed: DataFrame) -> DataFrame:
    """Where the observed set's median Spearman-Brown and its score variance fall among its controls."""
    seen = observed.select("module", F.col("median_sb").alias("observed_median_sb"))
    spread = observed.select("module", F.col("score_variance").alias("observed_score_variance"))
    placed = observed_percentile(controls, seen, ["module"], "median_sb", "observed_median_sb")
    varied = observed_percentile(controls, spread, ["module"], "score_variance", "observed_score_variance").select(
        "module", "observed_score_variance", F.col("percentile").alias("variance_percentile")
    )
    medians = controls.groupBy("module").agg(F.median("score_variance").alias("control_median_variance"), F.median("median_sb").alias("control_median_sb"))
    return placed.join(varied, "module").join(medians, "module", "left")


def reliability_context(control_r2: DataFrame, control_sb: DataFrame, observed: DataFrame) -> DataFrame:
    """Performance relative to reliability, observed against controls.

    control_r2 (module, control_id, r2), control_sb (module, control_id, median_sb),
    observed (module, observed_r2, observed_sb).
    """
    seen = observed.withColumn("observed_ratio", reliability_ratio(F.col("observed_r2"), F.col("observed_sb")))
    ratios = control_r2.join(control_sb, ["module", "control_id"]).select(
        "module", reliability_ratio(F.col("r2"), F.col("median_sb")).alias("ratio")
    )
    placed = observed_percentile(ratios, seen, ["module"], "ratio", "observed_ratio")
    return seen.join(placed.drop("observed_ratio"), "module", "left")
