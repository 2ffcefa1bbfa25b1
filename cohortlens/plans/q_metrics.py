"""Registered queries: aggregations, metrics, windows and top-k."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions.numeric import plus_one_p
from cohortlens.operators import folds, genesets, metrics, profile, ranks, resample
from cohortlens.plans import views as v
from cohortlens.plans.q_tables import FOLD_METRICS_SQL, _gene_table, zgenes
from cohortlens.plans.registry import query
from cohortlens.sources.tables import table


@query(
    "d01_sample_qc",
    """SELECT l.sample_id, coalesce(t, 0) AS total_counts, coalesce(g, 0) AS genes_detected, log10(t) AS log10_total_counts, log10(g) AS log10_genes_detected,
    lib AS reference_library_size, coalesce(t, 0) - lib AS library_size_delta FROM library l LEFT JOIN (
    SELECT sample_id, CAST(sum(cnt) AS BIGINT) AS t, count(*) AS g FROM counts WHERE cnt > 0 GROUP BY 1) c ON c.sample_id = l.sample_id""",
    ["log10_total_counts", "log10_genes_detected"],
)
def d01(spark, sf):
    return genesets.sample_qc(v.counts(spark, sf), v.library(spark, sf))


@query(
    "d02_gene_qc",
    """SELECT gene, detected_n, mean_log2cpm, detection_rate, variance_log2cpm, is_requested, modules, exclusion_reason FROM gene_table""",
    ["mean_log2cpm", "detection_rate", "variance_log2cpm"],
)
def d02(spark, sf):
    return _gene_table(spark, sf).select(
        "gene", "detected_n", "mean_log2cpm", "detection_rate", "variance_log2cpm", "is_requested", "modules", "exclusion_reason"
    )


@query("d03_module_scores", "SELECT sample_id, module, count(*) AS n_genes, avg(x) AS score FROM every_dense GROUP BY 1, 2", ["score"])
def d03(spark, sf):
    return genesets.module_scores(v.counts(spark, sf), v.library(spark, sf), v.every_set(spark, sf))


@query(
    "d04_module_coverage",
    """SELECT r.module, count(*) AS n_requested, count(p.gene) AS n_present, coalesce(string_agg(p.gene, ';' ORDER BY p.gene), '') AS genes_present,
    coalesce(string_agg(r.gene, ';' ORDER BY r.gene) FILTER (p.gene IS NULL), '') AS genes_missing, any_value(s.m) AS score_mean, any_value(s.sd) AS score_sd,
    count(p.gene) / count(*) AS coverage_fraction, count(p.gene) >= 2 AND count(p.gene) / count(*) >= 0.25 AS coverage_ok, count(p.gene) / count(*) < 0.5 AS coverage_warning
    FROM every_set r LEFT JOIN every_present p ON p.module = r.module AND p.gene = r.gene LEFT JOIN (
    SELECT module, avg(score) AS m, stddev_samp(score) AS sd FROM (SELECT sample_id, module, avg(x) AS score FROM every_dense GROUP BY 1, 2) GROUP BY 1) s ON s.module = r.module GROUP BY 1""",
    ["score_mean", "score_sd", "coverage_fraction"],
)
def d04(spark, sf):
    counts, requested = v.counts(spark, sf), v.every_set(spark, sf)
    return genesets.module_coverage(requested, counts, genesets.module_scores(counts, v.library(spark, sf), requested))


def dense(spark, sf):
    """Values of every brand's present genes in every sample, zeros included."""
    counts = v.counts(spark, sf)
    return v.staged(
        spark, sf, "dense", lambda: genesets.dense_members(counts, v.library(spark, sf), genesets.present_members(v.every_set(spark, sf), counts))
    )


LOO_SQL = """SELECT sample_id, module, gene, cnt, x, s / m AS score, (s - x) / nullif(m - 1, 0) AS loo, m FROM (
    SELECT *, sum(x) OVER (PARTITION BY sample_id, module) AS s, count(*) OVER (PARTITION BY sample_id, module) AS m FROM every_dense)"""


#: Scores with and without a member from sums of whole billionths, so that equal samples tie.
DOMINANCE_SQL = """SELECT sample_id, module, gene, cnt, x, s / (m * 1e9) AS score, (s - b) / nullif((m - 1) * 1e9, 0) AS loo, m FROM (
    SELECT *, CAST(sum(b) OVER (PARTITION BY sample_id, module) AS DOUBLE) AS s, count(*) OVER (PARTITION BY sample_id, module) AS m FROM (SELECT *, CAST(floor(x * 1e9 + 0.5) AS BIGINT) AS b FROM every_dense))"""


@query(
    "d05_module_dominance",
    f"""WITH r AS (SELECT *, rank() OVER (PARTITION BY module, gene ORDER BY x) + (count(*) OVER (PARTITION BY module, gene, x) - 1) / 2.0 AS rx,
    rank() OVER (PARTITION BY module, gene ORDER BY score) + (count(*) OVER (PARTITION BY module, gene, score) - 1) / 2.0 AS rs,
    rank() OVER (PARTITION BY module, gene ORDER BY loo) + (count(*) OVER (PARTITION BY module, gene, loo) - 1) / 2.0 AS rl FROM ({DOMINANCE_SQL})),
    t AS (SELECT module, gene, var_samp(x) AS gene_variance, avg(CASE WHEN cnt > 0 THEN 1.0 ELSE 0.0 END) AS nonzero_fraction, corr(x, score) AS gene_module_pearson,
    corr(rx, rs) AS gene_module_spearman, corr(x, loo) AS gene_loo_pearson, corr(rx, rl) AS gene_loo_spearman, corr(rs, rl) AS module_loo_spearman,
    covar_samp(x / m, score) / var_samp(score) AS covariance_share FROM r GROUP BY 1, 2)
    SELECT *, covariance_share >= 0.5 OR module_loo_spearman < 0.9 OR (abs(gene_loo_spearman) >= 0.9 AND gene_variance >= 2 * quantile_cont(gene_variance, 0.5) OVER (PARTITION BY module)) AS dominance_flag FROM t""",
    ["gene_variance", "nonzero_fraction", "gene_module_pearson", "gene_module_spearman", "gene_loo_pearson", "gene_loo_spearman", "module_loo_spearman", "covariance_share"],
)
def d05(spark, sf):
    return genesets.module_dominance(dense(spark, sf))


METRIC_COLUMNS = ["r2", "mae", "rmse", "spearman"]


@query("d06_regression_metrics", "SELECT module, model, n, r2, mae, rmse, spearman FROM perf", METRIC_COLUMNS)
def d06(spark, sf):
    return metrics.regression_metrics(v.oof(spark, sf), ["module", "model"])


@query("d07_performance_table", "SELECT module, model, analysis, n, r2, mae, rmse, spearman FROM perf", METRIC_COLUMNS)
def d07(spark, sf):
    return metrics.regression_metrics(v.oof(spark, sf), ["module", "model", "analysis"])


@query(
    "d08_fold_metrics",
    f"""SELECT module, model, max(CASE WHEN fold = 0 THEN r2 END) AS fold0_r2, max(CASE WHEN fold = 1 THEN r2 END) AS fold1_r2, max(CASE WHEN fold = 2 THEN r2 END) AS fold2_r2
    FROM ({FOLD_METRICS_SQL}) GROUP BY 1, 2""",
    ["fold0_r2", "fold1_r2", "fold2_r2"],
)
def d08(spark, sf):
    per_fold = metrics.regression_metrics(v.oof(spark, sf, ("ols", "stratum")), ["module", "model", "fold"], spearman=False)
    return metrics.fold_wide(per_fold, ["module", "model"], v.FOLDS)


@query(
    "d09_subset_metrics",
    """SELECT module, model, count(*) AS n, CAST(sum(CASE WHEN status = 'F' THEN 1 ELSE 0 END) AS BIGINT) AS n_subset,
    1 - sum(e * e) / (var_pop(y_true) * count(*)) AS r2, avg(abs(e)) AS mae, sqrt(avg(e * e)) AS rmse,
    1 - sum(e * e) FILTER (status = 'F') / (var_pop(y_true) FILTER (status = 'F') * count(*) FILTER (status = 'F')) AS r2_subset,
    avg(abs(e)) FILTER (status = 'F') AS mae_subset, sqrt(avg(e * e) FILTER (status = 'F')) AS rmse_subset FROM (SELECT *, y_true - y_pred AS e FROM oof) GROUP BY 1, 2""",
    ["r2", "mae", "rmse", "r2_subset", "mae_subset", "rmse_subset"],
)
def d09(spark, sf):
    return metrics.subset_metrics(v.oof(spark, sf), ["module", "model"], F.col("status") == "F")


@query(
    "d10_stratum_eligibility",
    """SELECT *, rank() OVER (ORDER BY n_cells DESC) AS cell_rank, CASE WHEN n_cells < 300 THEN 'below_cell_threshold' WHEN n_groups < 100 THEN 'below_group_threshold' ELSE '' END AS exclusion_reason,
    row_number() OVER (ORDER BY n_cells DESC, stratum) <= 2 AS is_top FROM (
    SELECT stratum, count(*) AS n_cells, count(DISTINCT group_id) AS n_groups, count(*) >= 300 AND count(DISTINCT group_id) >= 100 AS eligible FROM cells GROUP BY 1)""",
)
def d10(spark, sf):
    return folds.stratum_eligibility(v.cells(spark, sf), "stratum", "group_id", 300, 100)


@query(
    "d11_fold_composition",
    """SELECT k AS fold, s.stratum, coalesce(n, 0) AS n, coalesce(n, 0) / sum(n) OVER (PARTITION BY k) AS proportion,
    coalesce(n, 0) / sum(n) OVER (PARTITION BY k) - s.a / (SELECT count(*) FROM cells) AS deviation
    FROM folds3 CROSS JOIN (SELECT stratum, count(*) AS a FROM cells GROUP BY 1) s LEFT JOIN (SELECT fold, stratum, count(*) AS n FROM cells GROUP BY 1, 2) c ON c.fold = k AND c.stratum = s.stratum""",
    ["proportion", "deviation"],
)
def d11(spark, sf):
    return folds.fold_composition(v.cells(spark, sf), "stratum", v.FOLDS)


NUMERIC = ["f1", "f2", "f3", "f4", "f5", "f6"]


@query(
    "d12_cohort_tables",
    """SELECT feature, count(x) AS n, count(*) - count(x) AS n_missing, avg(x) AS mean, stddev_samp(x) AS sd, min(x) AS min, max(x) AS max,
    quantile_cont(x, 0.25) AS q1, quantile_cont(x, 0.5) AS median, quantile_cont(x, 0.75) AS q3
    FROM (SELECT f1, f2, f3, f4, f5, f6 FROM cells) UNPIVOT INCLUDE NULLS (x FOR feature IN (f1, f2, f3, f4, f5, f6)) GROUP BY 1""",
    ["mean", "sd", "min", "max", "q1", "median", "q3"],
)
def d12(spark, sf):
    return profile.numeric_profile(v.cells(spark, sf), NUMERIC)


@query(
    "d12_value_counts",
    """SELECT characteristic, coalesce(level, 'missing') AS level, count(*) AS n, count(*) / sum(count(*)) OVER (PARTITION BY characteristic) AS share
    FROM (SELECT stratum, status, CAST(fold AS VARCHAR) AS fold FROM cells) UNPIVOT INCLUDE NULLS (level FOR characteristic IN (stratum, status, fold)) GROUP BY 1, 2""",
    ["share"],
)
def d12b(spark, sf):
    return profile.cohort_counts(v.cells(spark, sf), ["stratum", "status", "fold"])


PROFILED = ["lang", "source", "quality", "toxic", "n_chars"]


@query(
    "d13_column_profile",
    """WITH long AS (SELECT * FROM (SELECT lang, source, CAST(quality AS VARCHAR) AS quality, CAST(toxic AS VARCHAR) AS toxic, CAST(n_chars AS VARCHAR) AS n_chars FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id)
    UNPIVOT INCLUDE NULLS (value FOR "column" IN (lang, source, quality, toxic, n_chars))),
    c AS (SELECT "column", value, count(*) AS n FROM long GROUP BY 1, 2),
    t AS (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn FROM c WHERE value IS NOT NULL),
    q AS (SELECT "column", quantile_cont(CAST(value AS DOUBLE), [0, 0.25, 0.5, 0.75, 1]) AS q FROM long WHERE "column" IN ('quality', 'toxic', 'n_chars') GROUP BY 1)
    SELECT "column", (SELECT q[1] FROM q WHERE q."column" = c."column") AS min, (SELECT q[2] FROM q WHERE q."column" = c."column") AS q1, (SELECT q[3] FROM q WHERE q."column" = c."column") AS median,
    (SELECT q[4] FROM q WHERE q."column" = c."column") AS q3, (SELECT q[5] FROM q WHERE q."column" = c."column") AS max, CAST(sum(n) AS BIGINT) AS n_rows, CAST(coalesce(sum(n) FILTER (value IS NULL), 0) AS BIGINT) AS n_missing, count(value) AS n_distinct,
    (SELECT '{' || string_agg('"' || value || '":' || CAST(n AS VARCHAR), ',' ORDER BY rn) || '}' FROM t WHERE t."column" = c."column" AND rn <= 20) AS top_values,
    CASE WHEN "column" IN ('quality', 'toxic') THEN 'int' WHEN "column" = 'n_chars' THEN 'bigint' ELSE 'string' END AS dtype, coalesce(sum(n) FILTER (value IS NULL), 0) / sum(n) AS missing_fraction FROM c GROUP BY 1""",
    ["missing_fraction", "min", "q1", "median", "q3", "max"],
)
def d13(spark, sf):
    rows = table(spark, sf, "documents").join(table(spark, sf, "labels"), "doc_id", "left")
    return profile.column_profile(rows, PROFILED)


@query(
    "d14_feature_dictionary",
    """WITH s AS (SELECT i, avg(x) AS center, stddev_pop(x) AS scale FROM vectors GROUP BY 1),
    z AS (SELECT v.i, greatest(least((v.x - s.center) / s.scale, 2.0), -2.0) AS z FROM vectors v JOIN s ON s.i = v.i)
    SELECT 'e' || CAST(z.i AS VARCHAR) AS feature, count(*) AS n, CAST(0 AS BIGINT) AS n_missing, CAST(sum(CASE WHEN z = 2 THEN 1 ELSE 0 END) AS BIGINT) AS n_at_upper,
    CAST(sum(CASE WHEN z = -2 THEN 1 ELSE 0 END) AS BIGINT) AS n_at_lower, any_value(s.center) AS center, any_value(s.scale) AS scale FROM z JOIN s ON s.i = z.i GROUP BY 1""",
    ["center", "scale"],
)
def d14(spark, sf):
    names = [f"e{i}" for i in range(64)]
    x = table(spark, sf, "embeddings").select(*[F.col("embedding")[i].cast("double").alias(n) for i, n in enumerate(names)])
    scales = x.unpivot([], names, "feature", "x").groupBy("feature").agg(F.avg("x").alias("center"), F.stddev_pop("x").alias("scale"))
    packed = scales.agg(F.map_from_entries(F.collect_list(F.struct("feature", F.struct("center", "scale"))))).scalar()
    from cohortlens.functions.numeric import clip

    z = x.withColumn("_s", packed).select(
        *[clip((F.col(n) - F.col("_s")[n]["center"]) / F.col("_s")[n]["scale"], -2.0, 2.0).alias(n) for n in names]
    )
    return profile.feature_dictionary(z, names, scales, 2.0)


DRAWS20 = """SELECT w.replicate, o.module, 1 - sum(w.w * (y_true - y_pred) * (y_true - y_pred)) / (sum(w.w * y_true * y_true) - sum(w.w * y_true) * sum(w.w * y_true) / sum(w.w)) AS r2,
    sum(w.w * abs(y_true - y_pred)) / sum(w.w) AS mae, sqrt(sum(w.w * (y_true - y_pred) * (y_true - y_pred)) / sum(w.w)) AS rmse, CAST(sum(w.w) AS BIGINT) AS n_sampled_rows
    FROM oof_ols o JOIN weights20 w ON w.group_id = o.group_id GROUP BY 1, 2"""


@query(
    "d15_bootstrap_interval",
    f"SELECT module, count(r2) AS n_draws, quantile_cont(r2, 0.025) AS ci_low, quantile_cont(r2, 0.975) AS ci_high FROM ({DRAWS20}) GROUP BY 1",
    ["ci_low", "ci_high"],
)
def d15(spark, sf):
    draws = resample.cluster_bootstrap(v.oof(spark, sf, ("ols",)), ["module"], n_resamples=20, spearman=False)
    return metrics.bootstrap_intervals(draws, ["module"], "r2")


@query(
    "d16_repeat_stability",
    f"""SELECT a.module, a.model, count(*) AS n_repeats, avg(a.r2) AS mean, stddev_samp(a.r2) AS sd, quantile_cont(a.r2, 0.5) AS median, quantile_cont(a.r2, 0.25) AS q1, quantile_cont(a.r2, 0.75) AS q3,
    quantile_cont(a.r2, 0.75) - quantile_cont(a.r2, 0.25) AS iqr, min(a.r2) AS min, max(a.r2) AS max, max(a.r2) - min(a.r2) AS range, avg(CASE WHEN a.r2 > 0 THEN 1.0 ELSE 0.0 END) AS fraction_gt0,
    any_value(p.r2) AS primary_value, CASE WHEN any_value(p.r2) < min(a.r2) THEN 'below' WHEN any_value(p.r2) > max(a.r2) THEN 'above' ELSE 'within' END AS primary_position
    FROM ({FOLD_METRICS_SQL}) a JOIN perf p ON p.module = a.module AND p.model = a.model GROUP BY 1, 2""",
    ["mean", "sd", "median", "q1", "q3", "iqr", "min", "max", "range", "fraction_gt0", "primary_value"],
)
def d16(spark, sf):
    """Folds stand in for repeats; the pooled value is the primary one."""
    rows = v.oof(spark, sf, ("ols", "stratum"))
    repeats = metrics.regression_metrics(rows, ["module", "model", "fold"], spearman=False)
    primary = metrics.regression_metrics(rows, ["module", "model"], spearman=False).withColumnRenamed("r2", "primary_value")
    return metrics.repeat_stability(repeats, primary, ["module", "model"])


SPEC_DOUBLES = ["observed", "observed_percentile", "control_median", "control_p90", "control_p95", "control_p99", "raw_p"]


@query("d17_specificity_summary", "SELECT * FROM specificity", SPEC_DOUBLES)
def d17(spark, sf):
    return metrics.specificity_summary(v.control_performance(spark, sf), v.observed_performance(spark, sf), ["module"])


@query(
    "d19_reconciliation_total",
    """SELECT CASE WHEN grouping(module) = 1 THEN 'ALL' ELSE module END AS module, count(*) AS n, sum(y_true - y_pred) AS total FROM oof_ols GROUP BY ROLLUP (module)""",
    ["total"],
    digits=4,
)
def d19(spark, sf):
    rows = v.oof(spark, sf, ("ols",))
    return profile.reconciliation_with_total(rows, "module", F.count(F.lit(1)), F.col("y_true") - F.col("y_pred"))


@query(
    "d20_pivot",
    """SELECT module, max(r2) FILTER (model = 'mean') AS mean, max(r2) FILTER (model = 'ols') AS ols, max(r2) FILTER (model = 'stratum') AS stratum FROM perf GROUP BY 1""",
    ["mean", "ols", "stratum"],
)
def d20(spark, sf):
    perf = metrics.regression_metrics(v.oof(spark, sf), ["module", "model"], spearman=False)
    return perf.groupBy("module").pivot("model", list(v.MODELS)).agg(F.first("r2"))


@query("d21_unpivot", "SELECT cell_id, target, y FROM cells UNPIVOT (y FOR target IN (line_value, list_price, order_total))", ["y"])
def d21(spark, sf):
    return v.y_table(spark, sf)


@query(
    "d24_disagreement_counts",
    """SELECT guess, CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END AS label, count(*) AS n FROM (
    SELECT CASE WHEN n_chars >= 500 THEN 'good' ELSE 'poor' END AS guess, quality FROM documents d JOIN labels l ON l.doc_id = d.doc_id)
    WHERE guess <> CASE WHEN quality = 1 THEN 'good' ELSE 'poor' END GROUP BY 1, 2""",
)
def d24(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", F.when(F.col("n_chars") >= 500, "good").otherwise("poor").alias("guess"))
    labels = table(spark, sf, "labels").select("doc_id", F.when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))
    return profile.disagreement_counts(docs.join(labels, "doc_id", "left"), "guess", "label")


@query(
    "d25_dataset_counters",
    """SELECT count(*) AS n_documents, count(l.doc_id) AS n_labelled, count(*) - count(l.doc_id) AS n_unlabelled, count(DISTINCT source) AS n_sources,
    CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS n_english, CAST(sum(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS BIGINT) AS n_good FROM documents d LEFT JOIN labels l ON l.doc_id = d.doc_id""",
)
def d25(spark, sf):
    rows = table(spark, sf, "documents").select("doc_id", "lang", "source").join(
        table(spark, sf, "labels").select("doc_id", "quality", F.lit(True).alias("hit")), "doc_id", "left"
    )
    return rows.agg(
        F.count(F.lit(1)).alias("n_documents"), F.count("hit").alias("n_labelled"), F.count_if(F.col("hit").isNull()).alias("n_unlabelled"),
        F.count_distinct("source").alias("n_sources"), F.count_if(F.col("lang") == "en").alias("n_english"), F.count_if(F.col("quality") == 1).alias("n_good"),
    )


@query(
    "d26_result_digest",
    """WITH b AS (SELECT module, model AS best_model, r2 AS best_r2, row_number() OVER (PARTITION BY module ORDER BY r2 DESC, model) AS rn FROM perf),
    g AS (SELECT module, max(r2) FILTER (model = 'ols') - max(r2) FILTER (model = 'stratum') AS model_delta FROM perf GROUP BY 1)
    SELECT b.module, best_model, best_r2, model_delta, row_number() OVER (ORDER BY best_r2 DESC, b.module) = 1 AS is_easiest, row_number() OVER (ORDER BY best_r2, b.module) = 1 AS is_hardest
    FROM b JOIN g ON g.module = b.module WHERE rn = 1""",
    ["best_r2", "model_delta"],
)
def d26(spark, sf):
    return metrics.result_digest(metrics.regression_metrics(v.oof(spark, sf), ["module", "model"], spearman=False), "ols", "stratum")


TOP_SQL = """SELECT module, model, cell_id, y_true, y_pred, pct, n FROM (SELECT *, count(*) OVER (PARTITION BY module, model) AS n,
    (rank() OVER (PARTITION BY module, model ORDER BY y_true) + (count(*) OVER (PARTITION BY module, model, y_true) - 1) / 2.0) / count(*) OVER (PARTITION BY module, model) AS pct,
    row_number() OVER (PARTITION BY module, model ORDER BY y_pred DESC, cell_id) AS rn FROM oof) WHERE rn <= ceil(CAST(0.1 AS DOUBLE) * n)"""
DECILE_SQL = f"""SELECT t.*, t.top_decile_observed_mean - o.m AS top_decile_mean_difference, t.top_decile_observed_mean / o.m AS top_decile_mean_ratio FROM (
    SELECT module, model, count(*) AS top_decile_n, avg(y_true) AS top_decile_observed_mean, quantile_cont(y_true, 0.5) AS top_decile_observed_median,
    avg(pct) AS top_decile_mean_observed_percentile FROM ({TOP_SQL}) GROUP BY 1, 2) t JOIN (SELECT module, model, avg(y_true) AS m FROM oof GROUP BY 1, 2) o ON o.module = t.module AND o.model = t.model"""
DECILE_DOUBLES = ["top_decile_observed_mean", "top_decile_observed_median", "top_decile_mean_observed_percentile", "top_decile_mean_difference", "top_decile_mean_ratio"]


@query(
    "d27_calibration",
    f"""SELECT s.module, s.model, n, 'PASS' AS status, '' AS reason, slope, m - slope * mp AS intercept, predicted_sd / observed_sd AS predicted_sd_ratio, predicted_range / observed_range AS range_ratio,
    observed_sd, predicted_sd, observed_range, predicted_range, d.top_decile_n, d.top_decile_observed_mean, d.top_decile_observed_median, m AS overall_observed_mean,
    d.top_decile_mean_difference, d.top_decile_mean_ratio, d.top_decile_mean_observed_percentile FROM (
    SELECT module, model, count(*) AS n, regr_slope(y_true, y_pred) AS slope, avg(y_true) AS m, avg(y_pred) AS mp, stddev_samp(y_true) AS observed_sd, stddev_samp(y_pred) AS predicted_sd,
    max(y_true) - min(y_true) AS observed_range, max(y_pred) - min(y_pred) AS predicted_range FROM oof GROUP BY 1, 2) s JOIN ({DECILE_SQL}) d ON d.module = s.module AND d.model = s.model WHERE s.model = 'ols'""",
    ["slope", "intercept", "predicted_sd_ratio", "range_ratio", "observed_sd", "predicted_sd", "observed_range", "predicted_range", "overall_observed_mean", *DECILE_DOUBLES],
    digits=5,
)
def d27(spark, sf):
    return metrics.calibration(v.oof(spark, sf, ("ols",)), ["module", "model"], "cell_id")


@query(
    "d28_compare_analyses",
    """SELECT a.module, m.metric, CASE m.metric WHEN 'r2' THEN a.r2 WHEN 'mae' THEN a.mae WHEN 'rmse' THEN a.rmse ELSE a.spearman END AS value_a,
    CASE m.metric WHEN 'r2' THEN b.r2 WHEN 'mae' THEN b.mae WHEN 'rmse' THEN b.rmse ELSE b.spearman END AS value_b,
    CASE m.metric WHEN 'r2' THEN a.r2 - b.r2 WHEN 'mae' THEN b.mae - a.mae WHEN 'rmse' THEN b.rmse - a.rmse ELSE a.spearman - b.spearman END AS delta
    FROM perf a JOIN perf b ON a.module = b.module AND a.model = 'ols' AND b.model = 'stratum' CROSS JOIN (SELECT unnest(['r2', 'mae', 'rmse', 'spearman']) AS metric) m""",
    ["value_a", "value_b", "delta"],
)
def d28(spark, sf):
    perf = metrics.regression_metrics(v.oof(spark, sf, ("ols", "stratum")), ["module", "model"])
    return metrics.compare_analyses(perf.filter("model = 'ols'"), perf.filter("model = 'stratum'"), ["module"])


@query(
    "d29_side_by_side",
    """SELECT 'all' AS definition, module, count(*) AS n, 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) AS r2 FROM oof_ols GROUP BY 2
    UNION ALL SELECT 'finished', module, count(*), 1 - sum((y_true - y_pred) ** 2) / (var_pop(y_true) * count(*)) FROM oof_ols WHERE status = 'F' GROUP BY 2""",
    ["r2"],
)
def d29(spark, sf):
    rows = v.oof(spark, sf, ("ols",))
    wide = metrics.subset_metrics(rows, ["module"], F.col("status") == "F")
    record = F.array(
        F.struct(F.lit("all").alias("definition"), F.col("n").alias("n"), F.col("r2").alias("r2")),
        F.struct(F.lit("finished").alias("definition"), F.col("n_subset").alias("n"), F.col("r2_subset").alias("r2")),
    )
    return wide.select("module", F.explode(record).alias("e")).select("e.definition", "module", "e.n", "e.r2")


@query(
    "d30_search_grid",
    """SELECT module, fold, alpha, l1_ratio, CAST(row_number() OVER (PARTITION BY module, fold ORDER BY alpha, l1_ratio) AS INTEGER) AS candidate FROM (
    SELECT DISTINCT module, fold FROM long_targets), (SELECT CAST(unnest([0.001, 0.01, 0.1, 1.0]) AS DOUBLE) AS alpha), (SELECT CAST(unnest([0.1, 0.5, 0.9]) AS DOUBLE) AS l1_ratio)""",
    ["alpha", "l1_ratio"],
)
def d30(spark, sf):
    """Every module and fold of the data with the candidates it is searched over."""
    from cohortlens.operators.expect import expected_grid
    from cohortlens.operators.gram import ALPHAS, L1_RATIOS

    grid = expected_grid(v.long_targets(spark, sf), ["module", "fold"], {"alpha": ALPHAS, "l1_ratio": L1_RATIOS})
    return grid.withColumn("candidate", F.row_number().over(W.partitionBy("module", "fold").orderBy("alpha", "l1_ratio")))


@query(
    "e01_average_rank",
    """SELECT event_id, rank() OVER (PARTITION BY event_type ORDER BY value) + (count(*) OVER (PARTITION BY event_type, value) - 1) / 2.0 AS value_rank FROM events""",
    ["value_rank"],
)
def e01(spark, sf):
    rows = table(spark, sf, "events").select("event_id", "event_type", "value")
    return ranks.value_ranks(rows, ["event_type"], {"value": "value_rank"}).select("event_id", "value_rank")


@query(
    "e02_min_rank_desc",
    "SELECT p_brand, p_type, n, rank() OVER (PARTITION BY p_brand ORDER BY n DESC) AS position FROM (SELECT p_brand, p_type, count(*) AS n FROM part GROUP BY 1, 2)",
)
def e02(spark, sf):
    counts = table(spark, sf, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"))
    return ranks.min_rank_desc(counts, ["p_brand"], "n", "position").select("p_brand", "p_type", "n", "position")


@query(
    "e03_ordered_position",
    "SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderpriority ORDER BY o_custkey DESC, o_orderkey) - 1 AS position FROM orders",
)
def e03(spark, sf):
    rows = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_orderpriority")
    return ranks.ordered_index(rows, ["o_orderpriority"], -F.col("o_custkey"), ["o_orderkey"]).select("o_orderkey", "position")


@query(
    "e04_group_centring",
    """SELECT module, cell_id, y_true - avg(y_true) OVER (PARTITION BY module, stratum) AS residual FROM oof_ols""",
    ["residual"],
)
def e04(spark, sf):
    rows = v.oof(spark, sf, ("ols",))
    return resample.centre_by_stratum(rows, ["module"], "stratum", ["y_true"]).select(
        "module", "cell_id", F.col("y_true_residual").alias("residual")
    )


P_SQL = """SELECT user_id, event_type, (1.0 + sum(CASE WHEN value > 20 THEN 1 ELSE 0 END)) / (count(*) + 1) AS p FROM events GROUP BY 1, 2"""


def _p_values(spark, sf):
    tallied = table(spark, sf, "events").groupBy("user_id", "event_type").agg(
        F.count_if(F.col("value") > 20).alias("k"), F.count(F.lit(1)).alias("n")
    )
    return tallied.select("user_id", "event_type", plus_one_p(F.col("k"), F.col("n")).alias("p"))


@query(
    "e05_bh_adjust",
    f"""SELECT user_id, event_type, p, bh_rank, family_n, least(1.0, min(family_n * p / bh_rank) OVER (PARTITION BY user_id ORDER BY bh_rank DESC ROWS UNBOUNDED PRECEDING)) AS bh_q FROM (
    SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY p, event_type) AS bh_rank, count(*) OVER (PARTITION BY user_id) AS family_n FROM ({P_SQL}))""",
    ["p", "bh_q"],
)
def e05(spark, sf):
    """A family is the five event types of a user."""
    return ranks.bh_adjust(_p_values(spark, sf), ["user_id"], "p", ["event_type"])


@query(
    "e06_specificity_family",
    """SELECT *, 0.05 * bh_rank / family_n AS bh_threshold, bh_q <= 0.05 AS rejected, 'return flags, one observed value each' AS family_label FROM (
    SELECT *, least(1.0, min(family_n * raw_p / bh_rank) OVER (ORDER BY bh_rank DESC ROWS UNBOUNDED PRECEDING)) AS bh_q FROM (
    SELECT *, row_number() OVER (ORDER BY raw_p, module) AS bh_rank, count(*) OVER () AS family_n FROM specificity))""",
    [*SPEC_DOUBLES, "bh_q", "bh_threshold"],
)
def e06(spark, sf):
    summary = metrics.specificity_summary(v.control_performance(spark, sf), v.observed_performance(spark, sf), ["module"])
    return ranks.bh_family(summary, [], "raw_p", ["module"], 0.05, "return flags, one observed value each")


@query(
    "e07_percent_rank",
    """SELECT module, model, cell_id, (rank() OVER (PARTITION BY module, model ORDER BY y_true) + (count(*) OVER (PARTITION BY module, model, y_true) - 1) / 2.0) / count(*) OVER (PARTITION BY module, model) AS pct
    FROM oof WHERE model = 'ols'""",
    ["pct"],
)
def e07(spark, sf):
    rows = v.oof(spark, sf, ("ols",)).select("module", "model", "cell_id", "y_true")
    return ranks.value_ranks(rows, ["module", "model"], {"y_true": "pct"}, share=True).drop("y_true")


@query(
    "e08_top_per_group",
    "SELECT o_custkey, o_orderkey, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn <= 3",
)
def e08(spark, sf):
    rows = table(spark, sf, "orders").select("o_custkey", "o_orderkey", "o_totalprice")
    return ranks.top_k(rows, ["o_custkey"], [F.desc("o_totalprice"), F.col("o_orderkey")], 3).drop("o_totalprice")


@query(
    "e09_early_stopping",
    """WITH RECURSIVE walk AS (
    SELECT run, step, loss AS best, step AS hit, false AS done FROM curves WHERE step = 1
    UNION ALL SELECT c.run, c.step, CASE WHEN NOT w.done AND c.step <= w.hit + 10 AND c.loss < w.best - 0.5 THEN c.loss ELSE w.best END,
    CASE WHEN NOT w.done AND c.step <= w.hit + 10 AND c.loss < w.best - 0.5 THEN c.step ELSE w.hit END, w.done OR c.step > w.hit + 10
    FROM walk w JOIN curves c ON c.run = w.run AND c.step = w.step + 1)
    SELECT run, max(step) AS n_steps, max(hit) AS best_step, arg_max(best, step) AS best_loss, least(max(hit) + 10, max(step)) AS stop_step, max(hit) + 10 <= max(step) AS stopped_early FROM walk GROUP BY 1""",
    ["best_loss"],
)
def e09(spark, sf):
    return ranks.early_stopping(v.curves(spark, sf), "run", "step", "loss", 0.5, 10)


@query(
    "e10_fold_rank_flag",
    """SELECT fold, feature, magnitude, fold_rank, fold_rank <= 2 AS in_top FROM (SELECT *, CAST(row_number() OVER (PARTITION BY fold ORDER BY magnitude DESC, feature) AS INTEGER) AS fold_rank FROM (
    SELECT fold, feature, avg(abs(x)) AS magnitude FROM cells UNPIVOT (x FOR feature IN (f1, f2, f3, f4, f5, f6)) GROUP BY 1, 2))""",
    ["magnitude"],
)
def e10(spark, sf):
    long = v.cells(spark, sf).select("fold", *NUMERIC).unpivot(["fold"], NUMERIC, "feature", "x")
    size = long.groupBy("fold", "feature").agg(F.avg(F.abs("x")).alias("magnitude"))
    placed = size.withColumn("fold_rank", F.row_number().over(W.partitionBy("fold").orderBy(F.desc("magnitude"), "feature")))
    return placed.withColumn("in_top", F.col("fold_rank") <= 2)


@query(
    "f01_total_order",
    "SELECT analysis, module, model, n, CAST(row_number() OVER (ORDER BY analysis, module, model) AS INTEGER) AS position FROM perf",
)
def f01(spark, sf):
    perf = v.oof(spark, sf).groupBy("analysis", "module", "model").agg(F.count(F.lit(1)).alias("n"))
    order = ["analysis", "module", "model"]
    return perf.withColumn("position", F.row_number().over(W.orderBy(*order))).orderBy(*order)


@query("f02_top_decile", f"SELECT * FROM ({DECILE_SQL})", DECILE_DOUBLES, digits=5)
def f02(spark, sf):
    return metrics.top_decile(v.oof(spark, sf).select("module", "model", "cell_id", "y_true", "y_pred"), ["module", "model"], "cell_id")


@query(
    "f03_top_k_overlap",
    """WITH c AS (SELECT p_brand, p_type, 'n' AS side, count(*) AS v FROM part GROUP BY 1, 2 UNION ALL SELECT p_brand, p_type, 'price', CAST(sum(CAST(round(p_retailprice * 100) AS BIGINT)) AS BIGINT) FROM part GROUP BY 1, 2),
    t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY p_brand, side ORDER BY v DESC, p_type) AS rn FROM c) WHERE rn <= 3)
    SELECT a.p_brand, CAST(count(b.p_type) AS BIGINT) AS overlap, count(b.p_type) / (2.0 * count(*) - count(b.p_type)) AS jaccard FROM t a LEFT JOIN t b ON b.p_brand = a.p_brand AND b.p_type = a.p_type AND b.side = 'price'
    WHERE a.side = 'n' GROUP BY 1""",
    ["jaccard"],
)
def f03(spark, sf):
    part = table(spark, sf, "part")
    sums = part.groupBy("p_brand", "p_type").agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.round(F.col("p_retailprice") * 100).cast("bigint")).alias("price")
    )
    long = sums.unpivot(["p_brand", "p_type"], ["n", "price"], "side", "v")
    top = ranks.top_k(long, ["p_brand", "side"], [F.desc("v"), F.col("p_type")], 3)
    return ranks.set_overlap(top, ["p_brand"], "side", "p_type", "n", "price")


@query(
    "f04_top_values",
    """SELECT "column", value, n, CAST(rn AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY "column" ORDER BY n DESC, value) AS rn FROM (
    SELECT 'lang' AS "column", lang AS value, count(*) AS n FROM documents GROUP BY 2 UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY 2
    UNION ALL SELECT 'n_chars', CAST(n_chars AS VARCHAR), count(*) FROM documents GROUP BY 2)) WHERE rn <= 20""",
)
def f04(spark, sf):
    return profile.top_values(table(spark, sf, "documents"), ["lang", "source", "n_chars"], 20)


@query(
    "f05_nearest_pools",
    """SELECT module, target_gene, gene, distance, CAST(rn AS INTEGER) AS pool_rank FROM (SELECT *, row_number() OVER (PARTITION BY module, target_gene ORDER BY distance, gene) AS rn FROM (
    SELECT p.module, p.gene AS target_gene, c.gene, sqrt((c.zx - t.zx) * (c.zx - t.zx) + (c.zd - t.zd) * (c.zd - t.zd)) AS distance
    FROM present p JOIN zgenes t ON t.gene = p.gene JOIN zgenes c ON c.candidate_eligible) WHERE distance <= 0.5) WHERE rn <= 128""",
    ["distance"],
)
def f05(spark, sf):
    from cohortlens.operators.matching import candidate_pools

    z = zgenes(spark, sf)
    return candidate_pools(z, v.requested(spark, sf), 0.5).select("module", "target_gene", "gene", "distance", "pool_rank")


@query(
    "f05_pool_shortfalls",
    """SELECT p.module, p.gene AS target_gene, m.n AS module_size, least(count(c.gene), 128) AS pool_size
    FROM present p JOIN (SELECT module, count(*) AS n FROM present GROUP BY 1) m ON m.module = p.module JOIN zgenes t ON t.gene = p.gene
    LEFT JOIN zgenes c ON c.candidate_eligible AND sqrt((c.zx - t.zx) * (c.zx - t.zx) + (c.zd - t.zd) * (c.zd - t.zd)) <= 0.1
    GROUP BY 1, 2, 3 HAVING least(count(c.gene), 128) < m.n""",
)
def f05b(spark, sf):
    from cohortlens.operators.matching import candidate_pools, pool_shortfalls

    z = zgenes(spark, sf)
    wanted = v.requested(spark, sf)
    return pool_shortfalls(z, wanted, candidate_pools(z, wanted, 0.1)).select("module", "target_gene", "module_size", "pool_size")
