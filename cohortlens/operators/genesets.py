"""Count QC, set-valued targets and weighted control targets over long, zero-suppressed counts.

Long counts hold (sample_id, gene, cnt) for non-zero cells only. A zero adds nothing to a sum of
log2(cpm+1) but counts in every mean, so means divide by the number of samples of the library table.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions.numeric import billionths, log2_cpm, safe_corr
from cohortlens.functions.text import identifier_issue, last_rule
from cohortlens.operators.blocks import set_products
from cohortlens.operators.ranks import value_ranks
from cohortlens.session import measured


def with_levels(df: DataFrame, levels: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Each row of df once per row of a short level list (modules, members, control ids)."""
    packed = levels.agg(F.array_sort(F.collect_list(F.struct(*columns)))).scalar()
    return df.withColumn("_levels", packed).withColumn("_level", F.explode("_levels")).select(
        *df.columns, *[F.col(f"_level.{c}").alias(c) for c in columns]
    )


def long_expression(counts: DataFrame, library: DataFrame) -> DataFrame:
    """(sample_id, gene, cnt, x) with x = log2(cpm + 1)."""
    return counts.join(library, "sample_id").select(
        "sample_id", "gene", "cnt", log2_cpm(F.col("cnt"), F.col("lib")).alias("x")
    )


def sample_qc(counts: DataFrame, library: DataFrame) -> DataFrame:
    """Totals and detected genes per sample, reconciled with the stored library size."""
    seen = counts.groupBy("sample_id").agg(
        F.sum("cnt").cast("bigint").alias("total_counts"), F.count_if(F.col("cnt") > 0).alias("genes_detected")
    )
    return library.join(seen, "sample_id", "left").select(
        "sample_id",
        F.coalesce("total_counts", F.lit(0)).alias("total_counts"),
        F.coalesce("genes_detected", F.lit(0)).alias("genes_detected"),
        F.when(F.col("total_counts") > 0, F.log10("total_counts")).alias("log10_total_counts"),
        F.when(F.col("genes_detected") > 0, F.log10("genes_detected")).alias("log10_genes_detected"),
        F.col("lib").alias("reference_library_size"),
        (F.coalesce("total_counts", F.lit(0)) - F.col("lib")).alias("library_size_delta"),
    )


def library_reconciliation(qc: DataFrame) -> DataFrame:
    delta = F.abs("library_size_delta")
    return qc.agg(
        F.count(F.lit(1)).alias("n_samples"),
        F.max(delta).alias("max_abs_delta"),
        F.count_if(delta > 0).alias("n_mismatched"),
        F.min("total_counts").alias("total_counts_min"),
        F.max("total_counts").alias("total_counts_max"),
        F.min("genes_detected").alias("genes_detected_min"),
        F.max("genes_detected").alias("genes_detected_max"),
    )


def gene_qc(
    counts: DataFrame,
    library: DataFrame,
    membership: DataFrame,
    alias_genes: Sequence[str] = (),
    catalog: DataFrame | None = None,
) -> DataFrame:
    """Moments, detection, eligibility as a matching candidate and why not.

    catalog may list every source symbol (with repeats); without it the symbols seen in counts are used.
    """
    n = library.agg(F.count(F.lit(1))).scalar()
    x = F.col("x")
    moments = (
        long_expression(counts, library)
        .groupBy("gene")
        .agg(
            F.count_if(F.col("cnt") > 0).alias("detected_n"),
            F.sum(x).alias("_sum"),
            F.avg(x).alias("_avg"),
            (F.var_pop(x) * F.count(x)).alias("_m2"),
            F.count(x).alias("_n"),
        )
        .withColumn("_all", n)
    )
    mean = F.col("_sum") / F.col("_all")
    spread = (
        F.col("_m2")
        + F.col("_n") * (F.col("_avg") - mean) * (F.col("_avg") - mean)
        + (F.col("_all") - F.col("_n")) * mean * mean
    )
    table = moments.select(
        "gene",
        F.col("detected_n"),
        mean.alias("mean_log2cpm"),
        (F.col("detected_n") / F.col("_all")).alias("detection_rate"),
        F.greatest(spread / F.col("_all"), F.lit(0.0)).alias("variance_log2cpm"),
    )
    if catalog is not None:
        symbols = catalog.groupBy("gene").agg((F.count(F.lit(1)) > 1).alias("duplicate_symbol"))
        zeros = {"detected_n": 0, "mean_log2cpm": 0.0, "detection_rate": 0.0, "variance_log2cpm": 0.0}
        table = symbols.join(table, "gene", "left").fillna(zeros)
    else:
        table = table.withColumn("duplicate_symbol", F.lit(False))
    wanted = membership.groupBy("gene").agg(F.concat_ws(";", F.array_sort(F.collect_set("module"))).alias("modules"))
    joined = table.join(wanted, "gene", "left").withColumn("identifier_issue", identifier_issue(F.col("gene")))
    requested = F.col("modules").isNotNull()
    alias = F.col("gene").isin(*alias_genes) if alias_genes else F.lit(False)
    rules = (
        (F.col("identifier_issue") != "", "invalid_identifier"),
        (F.col("duplicate_symbol"), "duplicate_symbol"),
        (requested, "primary_module_gene"),
        (alias, "alias_audit_gene"),
        (F.col("detection_rate") <= 0, "zero_detection"),
        (F.col("variance_log2cpm") <= 1e-12, "zero_variance"),
    )
    reason = last_rule(*rules)
    return joined.select(
        "gene",
        "detected_n",
        "mean_log2cpm",
        "detection_rate",
        "variance_log2cpm",
        "duplicate_symbol",
        "identifier_issue",
        requested.alias("is_requested"),
        F.coalesce("modules", F.lit("")).alias("modules"),
        (reason == "").alias("candidate_eligible"),
        reason.alias("exclusion_reason"),
    )


def present_members(membership: DataFrame, counts: DataFrame) -> DataFrame:
    """Members whose gene occurs in the counts at all."""
    return membership.join(counts.select("gene").distinct(), "gene", "left_semi")


def dense_members(counts: DataFrame, library: DataFrame, present: DataFrame) -> DataFrame:
    """(sample_id, module, gene, cnt, x) with explicit zeros for every sample and present member."""
    grid = with_levels(library, present.select("module", "gene"), ["module", "gene"])
    return grid.join(counts, ["sample_id", "gene"], "left").select(
        "sample_id",
        "module",
        "gene",
        F.coalesce("cnt", F.lit(0)).alias("cnt"),
        F.coalesce(log2_cpm(F.col("cnt"), F.col("lib")), F.lit(0.0)).alias("x"),
    )


def module_scores(counts: DataFrame, library: DataFrame, membership: DataFrame) -> DataFrame:
    """(sample_id, module, n_genes, score): mean log2(cpm+1) over the present members."""
    present = present_members(membership, counts)
    sizes = present.groupBy("module").agg(F.count(F.lit(1)).alias("n_genes"))
    hits = long_expression(counts, library).join(present.select("module", "gene"), "gene").select("sample_id", "module", "x")
    zeros = with_levels(library.select("sample_id"), sizes, ["module", "n_genes"]).select(
        "sample_id", "module", F.lit(0.0).alias("x")
    )
    sums = hits.unionByName(zeros).groupBy("sample_id", "module").agg(F.sum("x").alias("_sum"))
    return sums.join(sizes, "module").select(
        "sample_id", "module", "n_genes", (F.col("_sum") / F.col("n_genes")).alias("score")
    )


def module_coverage(requested: DataFrame, counts: DataFrame, scores: DataFrame) -> DataFrame:
    """Requested, present and missing members per module, the coverage gate and the score's spread."""
    known = counts.select("gene").distinct().withColumn("_hit", F.lit(True))
    marked = requested.join(known, "gene", "left").withColumn("_hit", F.coalesce("_hit", F.lit(False)))

    def names(condition: Column) -> Column:
        return F.concat_ws(";", F.array_sort(F.collect_list(F.when(condition, F.col("gene")))))

    hit = F.col("_hit")
    counted = marked.groupBy("module").agg(
        F.count(F.lit(1)).alias("n_requested"),
        F.count_if(hit).alias("n_present"),
        names(hit).alias("genes_present"),
        names(~hit).alias("genes_missing"),
    )
    spread = scores.groupBy("module").agg(F.avg("score").alias("score_mean"), F.stddev_samp("score").alias("score_sd"))
    share = F.col("n_present") / F.col("n_requested")
    return (
        counted.join(spread, "module", "left")
        .withColumn("coverage_fraction", share)
        .withColumn("coverage_ok", (F.col("n_present") >= 2) & (share >= 0.25))
        .withColumn("coverage_warning", share < 0.5)
    )


def module_dominance(dense: DataFrame) -> DataFrame:
    """Part-whole and leave-one-out diagnostics per member. The rest of a set is sum minus the member.

    Sums are taken in whole billionths: samples with the same members' values tie, in whatever order they are added.
    """
    member = W.partitionBy("sample_id", "module")
    rows = dense.select("sample_id", "module", "gene", "cnt", "x", billionths(F.col("x")).alias("_b"))
    rows = rows.withColumns({"_s": F.sum("_b").over(member), "_m": F.count(F.lit(1)).over(member)})
    rows = rows.withColumns(
        {
            "score": F.col("_s") / (F.col("_m") * F.lit(1e9)),
            "loo": F.when(F.col("_m") > 1, (F.col("_s") - F.col("_b")) / ((F.col("_m") - 1) * F.lit(1e9))),
        }
    ).drop("sample_id", "_b", "_s")
    keys = ["module", "gene"]
    ranked = value_ranks(measured(rows), keys, {"x": "rx", "score": "rs", "loo": "rl"})
    table = ranked.groupBy(*keys).agg(
        F.var_samp("x").alias("gene_variance"),
        F.avg((F.col("cnt") > 0).cast("double")).alias("nonzero_fraction"),
        safe_corr(F.col("x"), F.col("score")).alias("gene_module_pearson"),
        safe_corr(F.col("rx"), F.col("rs")).alias("gene_module_spearman"),
        safe_corr(F.col("x"), F.col("loo")).alias("gene_loo_pearson"),
        safe_corr(F.col("rx"), F.col("rl")).alias("gene_loo_spearman"),
        safe_corr(F.col("rs"), F.col("rl")).alias("module_loo_spearman"),
        F.try_divide(F.covar_samp(F.col("x") / F.col("_m"), F.col("score")), F.var_samp("score")).alias("covariance_share"),
    )
    middle = table.groupBy("module").agg(F.percentile("gene_variance", F.lit(0.5)).alias("_median"))
    flag = (
        (F.coalesce("covariance_share", F.lit(0.0)) >= 0.5)
        | (F.coalesce("module_loo_spearman", F.lit(1.0)) < 0.9)
        | (
            (F.abs(F.coalesce("gene_loo_spearman", F.lit(0.0))) >= 0.9)
            & (F.col("gene_variance") >= 2 * F.col("_median"))
        )
    )
    return table.join(middle, "module").withColumn("dominance_flag", flag).drop("_median")


def leave_one_out_scores(dense: DataFrame) -> DataFrame:
    """(sample_id, module, gene, score, loo_score): the set's score with and without each member."""
    member = W.partitionBy("sample_id", "module")
    s, m = F.sum("x").over(member), F.count(F.lit(1)).over(member)
    return dense.select(
        "sample_id",
        "module",
        "gene",
        (s / m).alias("score"),
        F.when(m > 1, (s - F.col("x")) / (m - 1)).alias("loo_score"),
    )


def alias_extended_scores(dense: DataFrame, extra: DataFrame) -> DataFrame:
    """Score with alias members added: (sum over present + alias) / (n + number of aliases)."""
    base = dense.groupBy("sample_id", "module").agg(F.sum("x").alias("_s"), F.count(F.lit(1)).alias("_m"))
    more = extra.groupBy("sample_id", "module").agg(F.sum("x").alias("_as"), F.count(F.lit(1)).alias("_am"))
    joined = base.join(more, ["sample_id", "module"])
    return joined.select(
        "sample_id",
        "module",
        (F.col("_s") / F.col("_m")).alias("score"),
        ((F.col("_s") + F.col("_as")) / (F.col("_m") + F.col("_am"))).alias("extended_score"),
    )


def standardised_members(dense: DataFrame) -> DataFrame:
    """Members as population z-scores."""
    stats = dense.groupBy("module", "gene").agg(F.avg("x").alias("_mean"), F.stddev_pop("x").alias("_scale"))
    return dense.join(measured(stats), ["module", "gene"]).withColumn("z", F.try_divide(F.col("x") - F.col("_mean"), F.col("_scale"))).drop(
        "_mean", "_scale"
    )


def first_components(standardised: DataFrame, max_members: int = 256) -> DataFrame:
    """(module, gene, loading, explained_ratio) of the first principal component per module.

    The member-by-member products are aggregated on the executors; only the small symmetric matrix of a
    module reaches the eigenvector step. The sign makes the component agree with the mean of z-scores.
    """
    member = standardised.select("module", "gene").distinct()
    place = member.withColumn("_i", F.row_number().over(W.partitionBy("module").orderBy("gene")) - 1)
    packed = (
        standardised.join(place, ["module", "gene"])
        .groupBy("module", "sample_id")
        .agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "z"))), lambda s: s["z"]).alias("v"))
    )

    def products(batches):
        # One partial matrix per module and partition: rows never leave their task.
        sums: dict[str, tuple] = {}
        import numpy as np

        for batch in batches:
            for module, part in batch.groupby("module"):
                v = np.stack(part["v"].to_numpy())
                old, n = sums.get(module, (0.0, 0))
                sums[module] = (old + v.T @ v, n + len(v))
        rows = [(m, g.ravel().tolist(), n) for m, (g, n) in sums.items()]
        yield pd.DataFrame(rows, columns=["module", "g", "n"])

    def leading(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        p = int(len(pdf["g"].iloc[0]) ** 0.5)
        gram = np.sum([np.asarray(g, dtype=float) for g in pdf["g"]], axis=0).reshape(p, p)
        values, vectors = np.linalg.eigh(gram)
        v = vectors[:, -1]
        lean = float(gram.sum(axis=0) @ v)
        if lean < -1e-12 or (abs(lean) <= 1e-12 and v[np.flatnonzero(np.abs(v) > 1e-14)[0]] < 0):
            v = -v
        ratio = float(values[-1] / values.sum()) if values.sum() > 0 else None
        return pd.DataFrame({"module": pdf["module"].iloc[0], "_i": range(p), "loading": v, "explained_ratio": ratio})

    partial = packed.mapInPandas(products, "module string, g array<double>, n bigint")
    loadings = partial.groupBy("module").applyInPandas(
        leading, "module string, _i int, loading double, explained_ratio double"
    )
    return place.join(loadings, ["module", "_i"]).select("module", "gene", "loading", "explained_ratio")


def target_definitions(standardised: DataFrame, loadings: DataFrame) -> DataFrame:
    """(sample_id, module, mean_score, zmean, pc1)."""
    return (
        standardised.join(loadings.select("module", "gene", "loading"), ["module", "gene"])
        .groupBy("sample_id", "module")
        .agg(
            F.avg("x").alias("mean_score"),
            F.avg("z").alias("zmean"),
            F.sum(F.col("z") * F.col("loading")).alias("pc1"),
        )
    )


def control_targets(expression: DataFrame, samples: DataFrame, sets: DataFrame) -> DataFrame:
    """(sample_id, module, control_id, y) from weighted membership (module, control_id, gene, weight), for every sample and set."""
    return set_products(expression, samples, sets, ["module", "control_id"], ["weight"]).withColumnRenamed("weight", "y")


def incomplete_controls(sets: DataFrame, counts: DataFrame) -> DataFrame:
    """Control sets with a member gene that the counts do not hold."""
    known = counts.select("gene").distinct().withColumn("_hit", F.lit(1))
    return (
        sets.join(known, "gene", "left")
        .groupBy("module", "control_id")
        .agg(F.count(F.lit(1)).alias("expected"), F.count("_hit").alias("seen"))
        .filter(F.col("expected") != F.col("seen"))
    )


def alias_matches(catalog: DataFrame, detected: DataFrame, name: str) -> DataFrame:
    """How catalogue symbols relate to a searched name, with detection counts."""
    symbol = F.col("gene")
    folded = F.lower(F.trim(symbol))
    wanted = name.strip().lower()
    return (
        catalog.filter(folded.contains(wanted))
        .join(detected, "gene", "left")
        .select(
            "gene",
            (symbol == name).alias("is_exact"),
            (folded == wanted).alias("is_exact_folded"),
            folded.contains(wanted).alias("is_substring"),
            (symbol != F.trim(symbol)).alias("is_whitespace_variant"),
            F.coalesce("detected_n", F.lit(0)).alias("detected_n"),
        )
    )
