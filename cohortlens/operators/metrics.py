"""Grouped regression metrics, calibration, comparison, stability and specificity summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions.numeric import finite, plus_one_p
from cohortlens.functions.rules import range_position
from cohortlens.operators.rankcorr import spearman as rank_correlation
from cohortlens.operators.ranks import cumulative_counts, exact_quantiles, top_fraction
from cohortlens.session import cut_lineage, measured

METRICS = ("r2", "mae", "rmse", "spearman")


def _r2(y: Column, p: Column) -> Column:
    sse = F.sum((y - p) * (y - p))
    sst = F.var_pop(y) * F.count(y)
    flat = F.when(sse == 0, F.lit(1.0)).otherwise(F.lit(0.0))
    return F.when(sst == 0, flat).otherwise(1 - F.try_divide(sse, sst))


def error_metrics(y: str, p: str, when: Column | None = None) -> dict[str, Column]:
    """R2, MAE and RMSE aggregates over rows where both values are finite (and `when` holds)."""
    truth, guess = finite(F.col(y)), finite(F.col(p))
    usable = truth.isNotNull() & guess.isNotNull()
    if when is not None:
        usable = usable & when
    truth, guess = F.when(usable, truth), F.when(usable, guess)
    enough = F.count(truth) >= 2
    return {
        "r2": F.when(enough, _r2(truth, guess)),
        "mae": F.when(enough, F.avg(F.abs(truth - guess))),
        "rmse": F.when(enough, F.sqrt(F.avg((truth - guess) * (truth - guess)))),
    }


def paired_finite(df: DataFrame, y: str, p: str) -> DataFrame:
    """Both values set to NULL unless both are finite, so ranks only see complete pairs."""
    truth, guess = finite(F.col(y)), finite(F.col(p))
    usable = truth.isNotNull() & guess.isNotNull()
    return df.withColumns({y: F.when(usable, truth), p: F.when(usable, guess)})


def regression_metrics(
    df: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred", spearman: bool = True
) -> DataFrame:
    """n, R2, MAE, RMSE and Spearman per key; NULL with fewer than two finite pairs."""
    by = list(by)
    clean = paired_finite(df, y, p)
    n = F.count(F.lit(1)).alias("n")
    basic = {name: column.alias(name) for name, column in error_metrics(y, p).items()}
    if not spearman:
        return clean.groupBy(*by).agg(n, *basic.values())
    table = measured(clean.groupBy(*by).agg(n, *basic.values()))
    rho = rank_correlation(clean, by, y, p, table).select(*by, F.col("rho").alias("spearman"))
    return table.join(rho, by, "left")


def subset_metrics(df: DataFrame, by: Sequence[str], inside: Column, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """The same metrics on all rows and on a restricted cohort, side by side from one scan."""
    whole = error_metrics(y, p)
    part = error_metrics(y, p, inside)
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(inside).alias("n_subset"),
        *[c.alias(k) for k, c in whole.items()],
        *[c.alias(f"{k}_subset") for k, c in part.items()],
    )


def fold_wide(per_fold: DataFrame, by: Sequence[str], folds: Sequence[int], metric: str = "r2") -> DataFrame:
    """fold0_r2, fold1_r2, ... from a per-fold metric table."""
    wide = per_fold.groupBy(*by).pivot("fold", list(folds)).agg(F.first(metric))
    return wide.select(*by, *[F.col(f"`{k}`").alias(f"fold{k}_{metric}") for k in folds])


def calibration(df: DataFrame, by: Sequence[str], cell: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Slope and intercept of truth on prediction, spread ratios and top-decile enrichment."""
    by = list(by)
    bad = finite(F.col(y)).isNull() | finite(F.col(p)).isNull()
    spread = df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.count_if(bad).alias("_bad"),
        F.stddev_samp(y).alias("observed_sd"),
        F.stddev_samp(p).alias("predicted_sd"),
        (F.max(y) - F.min(y)).alias("observed_range"),
        (F.max(p) - F.min(p)).alias("predicted_range"),
        F.covar_samp(p, y).alias("_cov"),
        F.avg(y).alias("overall_observed_mean"),
        F.avg(p).alias("_mean_p"),
    )
    flat = (F.col("predicted_sd") == 0) | (F.col("observed_sd") == 0) | (F.col("observed_range") == 0)
    reason = (
        F.when((F.col("n") < 2) | (F.col("_bad") > 0), "insufficient_or_nonfinite")
        .when(F.coalesce(flat, F.lit(True)), "zero_variance_or_range")
        .otherwise("")
    )
    slope = F.try_divide(F.col("_cov"), F.col("predicted_sd") * F.col("predicted_sd"))
    table = spread.join(top_decile(df, by, cell, y, p), by, "left").withColumn("reason", reason)
    ok = F.col("reason") == ""
    return table.select(
        *by,
        "n",
        F.when(ok, "PASS").otherwise("not_calculable").alias("status"),
        "reason",
        F.when(ok, slope).alias("slope"),
        F.when(ok, F.col("overall_observed_mean") - slope * F.col("_mean_p")).alias("intercept"),
        F.when(ok, F.try_divide(F.col("predicted_sd"), F.col("observed_sd"))).alias("predicted_sd_ratio"),
        F.when(ok, F.try_divide(F.col("predicted_range"), F.col("observed_range"))).alias("range_ratio"),
        *[
            F.when(ok, F.col(name)).alias(name)
            for name in (
                "observed_sd",
                "predicted_sd",
                "observed_range",
                "predicted_range",
                "top_decile_n",
                "top_decile_observed_mean",
                "top_decile_observed_median",
                "overall_observed_mean",
                "top_decile_mean_difference",
                "top_decile_mean_ratio",
                "top_decile_mean_observed_percentile",
            )
        ],
    )


def top_decile(df: DataFrame, by: Sequence[str], cell: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """How enriched the top tenth by prediction is in truth, per key."""
    by = list(by)
    clean = paired_finite(df.select(*by, cell, y, p), y, p).filter(F.col(y).isNotNull())
    top = cut_lineage(top_fraction(clean, by, p, cell, 0.10))
    counts = cumulative_counts(clean, by, y)
    share = (F.col("n_before") + (F.col("n") + 1) / 2.0) / F.col("n_total")
    placed = top.join(counts.select(*by, y, share.alias("_pct")), [*by, y])
    overall = clean.groupBy(*by).agg(F.avg(y).alias("_mean"))
    middle = exact_quantiles(top, by, y, {"top_decile_observed_median": 0.5}).drop("n")
    summary = placed.groupBy(*by).agg(
        F.count(F.lit(1)).alias("top_decile_n"),
        F.avg(y).alias("top_decile_observed_mean"),
        F.avg("_pct").alias("top_decile_mean_observed_percentile"),
    )
    mean = F.col("top_decile_observed_mean")
    return summary.join(middle, by).join(overall, by).select(
        *by,
        "top_decile_n",
        "top_decile_observed_mean",
        "top_decile_observed_median",
        (mean - F.col("_mean")).alias("top_decile_mean_difference"),
        F.when(F.col("_mean") != 0, F.try_divide(mean, F.col("_mean"))).alias("top_decile_mean_ratio"),
        "top_decile_mean_observed_percentile",
    )


def oriented_delta(metric: Column, a: Column, b: Column) -> Column:
    """a - b, negated for error metrics so that a positive value always means a is better."""
    return F.when(metric.isin("mae", "rmse"), b - a).otherwise(a - b)


def melt_metrics(table: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS) -> DataFrame:
    return table.select(*keys, *metrics).unpivot(list(keys), list(metrics), "metric", "value")


def compare_analyses(
    a: DataFrame, b: DataFrame, keys: Sequence[str], metrics: Sequence[str] = METRICS
) -> DataFrame:
    """One row per key and metric with both values and the oriented delta of a over b."""
    keys = list(keys)
    left = melt_metrics(a, keys, metrics).withColumnRenamed("value", "value_a")
    right = melt_metrics(b, keys, metrics).withColumnRenamed("value", "value_b")
    return left.join(right, [*keys, "metric"]).withColumn(
        "delta", oriented_delta(F.col("metric"), F.col("value_a"), F.col("value_b"))
    )


def bootstrap_intervals(draws: DataFrame, by: Sequence[str], value: str = "value") -> DataFrame:
    """Percentile interval per key; a key holds one row per replicate, so the exact aggregate is bounded."""
    x = finite(F.col(value))
    ends = F.percentile(x, F.array(F.lit(0.025), F.lit(0.975)))
    return (
        draws.groupBy(*by)
        .agg(F.count(x).alias("n_draws"), ends.alias("_ends"))
        .select(*by, "n_draws", F.col("_ends")[0].alias("ci_low"), F.col("_ends")[1].alias("ci_high"))
    )


def repeat_stability(repeats: DataFrame, primary: DataFrame, by: Sequence[str], value: str = "r2") -> DataFrame:
    """Spread of a metric over repeated runs and where the primary run falls in it.

    repeats holds one row per key and repeat; primary one row per key with the column primary_value.
    """
    by = list(by)
    x = F.col(value)
    stats = repeats.groupBy(*by).agg(
        F.count(x).alias("n_repeats"),
        F.avg(x).alias("mean"),
        F.stddev_samp(x).alias("sd"),
        F.percentile(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias("_q"),
        F.min(x).alias("min"),
        F.max(x).alias("max"),
        F.avg((x > 0).cast("double")).alias("fraction_gt0"),
    )
    return stats.join(primary.select(*by, "primary_value"), by, "left").select(
        *by,
        "n_repeats",
        "mean",
        "sd",
        F.col("_q")[1].alias("median"),
        F.col("_q")[0].alias("q1"),
        F.col("_q")[2].alias("q3"),
        (F.col("_q")[2] - F.col("_q")[0]).alias("iqr"),
        "min",
        "max",
        (F.col("max") - F.col("min")).alias("range"),
        "fraction_gt0",
        "primary_value",
        range_position(F.col("primary_value"), F.col("min"), F.col("max")).alias("primary_position"),
    )


def specificity_summary(
    controls: DataFrame, observed: DataFrame, by: Sequence[str], value: str = "r2", observed_value: str = "observed"
) -> DataFrame:
    """Where each observed value falls in the distribution of its matched controls."""
    by = list(by)
    joined = controls.select(*by, value).join(observed.select(*by, observed_value), by)
    x, seen = F.col(value), F.col(observed_value)
    counts = joined.groupBy(*by).agg(
        F.max(seen).alias(observed_value),
        F.count(x).alias("control_n"),
        F.count_if(x >= seen).alias("extreme_count"),
        F.try_divide(100.0 * F.count_if(x <= seen), F.count(x)).alias("observed_percentile"),
    )
    quantiles = exact_quantiles(
        controls, by, value, {"control_median": 0.5, "control_p90": 0.9, "control_p95": 0.95, "control_p99": 0.99}
    ).drop("n")
    return counts.join(quantiles, by).withColumn("raw_p", plus_one_p(F.col("extreme_count"), F.col("control_n")))


def observed_percentile(
    controls: DataFrame, observed: DataFrame, by: Sequence[str], value: str, observed_value: str
) -> DataFrame:
    """100 * share of finite control values at or below the observed one."""
    by = list(by)
    x = finite(F.col(value))
    return (
        controls.select(*by, x.alias("_x"))
        .join(observed.select(*by, observed_value), by)
        .groupBy(*by)
        .agg(
            F.max(observed_value).alias(observed_value),
            F.count("_x").alias("control_valid_n"),
            F.try_divide(100.0 * F.count_if(F.col("_x") <= F.col(observed_value)), F.count("_x")).alias("percentile"),
        )
    )


def attribution_stability(long: DataFrame, top: int = 5) -> DataFrame:
    """Fold stability of |attribution| from rows (cell_id, module, fold, feature, value)."""
    per_fold = long.groupBy("module", "fold", "feature").agg(F.avg(F.abs("value")).alias("magnitude"))
    ranked = per_fold.withColumn(
        "fold_rank",
        F.row_number().over(W.partitionBy("module", "fold").orderBy(F.desc("magnitude"), "feature")),
    ).withColumn("in_top", (F.col("fold_rank") <= top).cast("double"))
    folds = per_fold.groupBy("module").agg(F.count_distinct("fold").alias("_folds"))
    summary = ranked.groupBy("module", "feature").agg(
        F.avg("magnitude").alias("mean_abs"),
        F.stddev_samp("magnitude").alias("sd_abs"),
        F.avg("fold_rank").alias("mean_fold_rank"),
        F.max("fold_rank").alias("max_fold_rank"),
        F.avg("in_top").alias("top_frequency"),
        F.count_distinct("fold").alias("folds_observed"),
    )
    stable = (F.col("top_frequency") >= F.lit(2.0 / 3.0)) & (F.col("folds_observed") == F.col("_folds"))
    return (
        summary.join(folds, "module")
        .withColumn("stable_top", stable)
        .withColumn("overall_rank", F.rank().over(W.partitionBy("module").orderBy(F.desc("mean_abs"))))
        .drop("_folds")
    )


def grouped_attribution(long: DataFrame, components: DataFrame) -> DataFrame:
    """Per component: sum of |value| per cell, mean per fold, then the equal-weight mean of fold means.

    The cell-level sum distributes over the mean, so rows are reduced per (fold, feature) first.
    """
    cells = long.groupBy("module", "fold", "feature").agg(
        F.sum(F.abs("value")).alias("_sum"), F.count("value").alias("_n")
    )
    width = cells.groupBy("module", "fold").agg(F.max("_n").alias("_cells"))
    per_fold = (
        cells.join(components.select("feature", "component_id"), "feature")
        .groupBy("module", "fold", "component_id")
        .agg(F.sum("_sum").alias("_sum"))
        .join(width, ["module", "fold"])
        .withColumn("fold_mean", F.try_divide(F.col("_sum"), F.col("_cells")))
    )
    return per_fold.groupBy("module", "component_id").agg(
        F.avg("fold_mean").alias("mean_abs"), F.count("fold").alias("n_folds")
    )


def result_digest(performance: DataFrame, model_a: str, model_b: str) -> DataFrame:
    """Best model per module, difficulty rank and the advantage of model_a over model_b."""
    best = W.partitionBy("module").orderBy(F.desc("r2"), "model")
    winners = performance.withColumn("_rn", F.row_number().over(best)).filter(F.col("_rn") == 1)
    gap = performance.groupBy("module").agg(
        (F.max(F.when(F.col("model") == model_a, F.col("r2"))) - F.max(F.when(F.col("model") == model_b, F.col("r2")))).alias(
            "model_delta"
        )
    )
    easy = winners.select("module", F.col("model").alias("best_model"), F.col("r2").alias("best_r2")).join(gap, "module")
    whole = W.orderBy(F.desc("best_r2"), "module")
    hard = W.orderBy(F.asc("best_r2"), "module")
    return easy.withColumn("is_easiest", F.row_number().over(whole) == 1).withColumn(
        "is_hardest", F.row_number().over(hard) == 1
    )
