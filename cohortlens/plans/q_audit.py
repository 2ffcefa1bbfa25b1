"""Registered queries: data-quality checks, provenance, incremental work lists and streaming."""

from __future__ import annotations

from pyspark.sql import functions as F

from cohortlens.functions.numeric import plus_one_p
from cohortlens.operators import expect, genesets, gram, metrics, provenance, resample
from cohortlens.plans import views as v
from cohortlens.plans.q_inference import DELTAS
from cohortlens.plans.q_metrics import DRAWS20
from cohortlens.plans.q_models import attributions, fits
from cohortlens.plans.q_tables import _manifest
from cohortlens.plans.registry import query
from cohortlens.session import cut_lineage
from cohortlens.sources import sinks
from cohortlens.sources.tables import table
from cohortlens.streaming import count_qc


@query("x01_duplicate_keys", "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def x01(spark, sf):
    return expect.duplicate_keys(table(spark, sf, "lineitem"), ["l_orderkey", "l_linenumber"])


@query(
    "x02_exactly_once",
    """SELECT m.module, m.model, CAST(count(o.cell_id) AS BIGINT) AS n_rows, CAST(0 AS BIGINT) AS n_duplicated, count(*) - count(o.cell_id) AS n_missing, CAST(0 AS BIGINT) AS n_extra, CAST(0 AS BIGINT) AS n_nonfinite,
    count(*) = count(o.cell_id) AS exactly_once FROM (SELECT CAST(o_orderkey AS VARCHAR) AS cell_id FROM orders) c CROSS JOIN (SELECT DISTINCT module, model FROM oof) m
    LEFT JOIN oof o ON o.cell_id = c.cell_id AND o.module = m.module AND o.model = m.model GROUP BY 1, 2""",
)
def x02(spark, sf):
    """Expected cells are all orders; those without lines have no prediction and are counted as missing."""
    cells = table(spark, sf, "orders").select(v.text("o_orderkey").alias("cell_id"))
    return expect.oof_audit(v.oof(spark, sf), cells, {"module": v.TARGETS, "model": v.MODELS})


@query(
    "x03_identity_audit",
    """SELECT * FROM (VALUES ('group_id'), ('stratum'), ('fold'), ('unmatched')) AS c("check") CROSS JOIN (SELECT CAST(0 AS BIGINT) AS n_violations)
    UNION ALL SELECT 'y_true', count(*) FROM oof WHERE module <> 'line_value'""",
)
def x03(spark, sf):
    """Predictions of every module compared with the frozen table of one: only that module's truth agrees."""
    frozen = v.cells(spark, sf).withColumn("y_true", F.col("line_value"))
    return expect.identity_audit(v.oof(spark, sf), frozen, "cell_id", ["group_id", "stratum", "fold", "y_true"])


@query(
    "x04_group_in_one_fold",
    "SELECT o_custkey AS group_id, count(DISTINCT o_orderkey % 3) AS n_sides FROM orders GROUP BY 1 HAVING count(DISTINCT o_orderkey % 3) > 1",
)
def x04(spark, sf):
    """Folds taken from the row instead of its group: every group they tear apart."""
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("group_id"), (F.col("o_orderkey") % 3).alias("fold"))
    return expect.shared_groups(rows, "group_id", "fold")


@query("x05_attribution_coverage")
def x05(spark, sf):
    """Schema and coverage of the attribution table: every cell, module and feature once."""
    rows = attributions(spark, sf).withColumns({"y_true": F.col("base"), "y_pred": F.col("value")})
    return expect.oof_audit(rows, v.cells(spark, sf), {"module": v.TARGETS, "feature": v.FEATURES})


@query(
    "x06_table_reconstruction",
    """SELECT m."column", CAST(0 AS BIGINT) AS n_one_sided, count(*) FILTER (d > 0) AS n_different, max(d) AS max_abs_diff FROM (
    SELECT m."column", abs(CASE m."column" WHEN 'r2' THEN r2 - round(r2, 2) WHEN 'mae' THEN mae - round(mae, 2) ELSE rmse - round(rmse, 2) END) AS d FROM perf CROSS JOIN (SELECT unnest(['r2', 'mae', 'rmse']) AS "column") m) m GROUP BY 1""",
    ["max_abs_diff"],
)
def x06(spark, sf):
    """A stored table rounded to two digits does not survive the comparison with the recomputed one."""
    perf = metrics.regression_metrics(v.oof(spark, sf), ["module", "model"], spearman=False)
    stored = perf.withColumns({c: F.round(c, 2) for c in ("r2", "mae", "rmse")})
    return expect.compare_tables(perf, stored, ["module", "model"], ["r2", "mae", "rmse"])


def _altered_manifest(spark, sf):
    """The manifest as recorded, with the marks of what can go wrong derived from it."""
    kept = cut_lineage(_manifest(spark, sf).select("path", "bytes", "sha256"))
    named = F.col("path")
    wrong = kept.withColumn("bytes", F.when(named.startswith("n"), F.col("bytes") + 1).otherwise(F.col("bytes"))).withColumn(
        "sha256", F.when(named.startswith("r"), F.lit("0")).otherwise(F.col("sha256"))
    )
    twice = kept.filter(named.startswith("s"))
    gone = kept.filter(named.startswith("e")).withColumn("path", F.concat(F.lit("gone_"), named))
    outside = kept.filter(named.startswith("p")).withColumn("path", F.concat(F.lit("../"), named))
    return wrong.filter(~named.startswith("l")).unionByName(twice).unionByName(gone).unionByName(outside)


@query("x08_manifest_status")
def x08(spark, sf):
    return provenance.manifest_status(_altered_manifest(spark, sf), _manifest(spark, sf))


@query("x09_stage_receipts")
def x09(spark, sf):
    """A stage's receipt written as a table and checked against the files as they are and as altered."""
    path = v.scratch(spark)
    sinks.write_table(provenance.stage_receipt(_manifest(spark, sf), "inputs", ""), path)
    receipt, manifest = spark.read.parquet(path), cut_lineage(_manifest(spark, sf))
    same = provenance.receipt_valid(receipt, manifest).withColumn("against", F.lit("same"))
    other = provenance.receipt_valid(receipt, manifest.withColumn("sha256", F.when(F.col("path").startswith("r"), F.lit("0")).otherwise(F.col("sha256"))))
    return same.unionByName(other.withColumn("against", F.lit("altered")))


@query(
    "x10_incremental_work_list",
    """SELECT module, control_id FROM (SELECT DISTINCT stratum AS module, fold AS control_id FROM cells) WHERE control_id = 1 OR module = '5-LOW'""",
)
def x10(spark, sf):
    """Stored partitions by stratum and fold; one fold was cut short and one stratum ran under another configuration."""
    rows = v.oof(spark, sf, ("ols",)).filter("module = 'line_value'").select(
        F.col("stratum").alias("module"), F.col("fold").alias("control_id"), "cell_id", "y_true", "y_pred"
    )
    signed = rows.withColumn("run_signature", F.when(F.col("module") == "5-LOW", "old").otherwise("now"))
    path = v.scratch(spark)
    sinks.write_partitions(signed.filter("control_id <> 1"), path, ["module", "control_id"])
    partial = signed.filter("control_id = 1").withColumn("y_pred", F.lit(float("nan")))
    sinks.append_batch(partial, path, ["module", "control_id"])
    truth = v.cells(spark, sf).select(F.col("stratum").alias("module"), "cell_id", F.col("line_value").alias("y_true"))
    wanted = truth.select("module").distinct().withColumn("run_signature", F.lit("now"))
    stored = spark.read.parquet(path)
    validity = provenance.partition_validity(stored, truth, wanted)
    sizes = v.cells(spark, sf).groupBy(F.col("stratum").alias("module"), F.col("fold").alias("control_id")).agg(F.count(F.lit(1)).alias("expected_n"))
    sized = validity.join(sizes, ["module", "control_id"])
    return provenance.work_list(sizes.select("module", "control_id"), sized, F.col("expected_n"))


@query(
    "x11_configuration_digest",
    """SELECT module, fold, sha256('fold=' || CAST(fold AS VARCHAR) || chr(10) || 'module=' || module || chr(10) || 'seed=' || CAST(seed AS VARCHAR)) AS digest
    FROM (SELECT module, fold, count(*) AS seed FROM long_targets GROUP BY 1, 2)""",
)
def x11(spark, sf):
    table_ = v.long_targets(spark, sf).groupBy("module", "fold").agg(F.count(F.lit(1)).alias("seed"))
    return table_.select("module", "fold", provenance.config_digest(["module", "fold", "seed"]).alias("digest"))


@query("x12_provenance")
def x12(spark, sf):
    return provenance.provenance_table(_manifest(spark, sf), "read_only_input")


@query(
    "x13_library_reconciliation",
    """SELECT count(*) AS n_samples, max(abs(t - lib)) AS max_abs_delta, count(*) FILTER (t <> lib) AS n_mismatched, min(t) AS total_counts_min, max(t) AS total_counts_max, min(g) AS genes_detected_min, max(g) AS genes_detected_max
    FROM library l JOIN (SELECT sample_id, CAST(sum(cnt) AS BIGINT) AS t, count(*) AS g FROM counts GROUP BY 1) c ON c.sample_id = l.sample_id""",
)
def x13(spark, sf):
    return genesets.library_reconciliation(genesets.sample_qc(v.counts(spark, sf), v.library(spark, sf)))


@query(
    "x15_modelling_view",
    """SELECT * FROM (VALUES ('missing_in_targets'), ('null_f1'), ('null_f2'), ('fold_out_of_set'), ('duplicate_in_features'), ('duplicate_in_folds'), ('duplicate_in_targets'), ('group_in_several_folds')) AS c("check") CROSS JOIN (SELECT CAST(0 AS BIGINT) AS n)
    UNION ALL SELECT 'null_f6', count(*) FROM cells WHERE f6 IS NULL UNION ALL SELECT 'missing_in_features', (SELECT count(*) FROM orders) - (SELECT count(*) FROM cells) UNION ALL SELECT 'missing_in_folds', CAST(0 AS BIGINT)""",
)
def x15(spark, sf):
    """Features, folds of every order and targets brought together; orders without lines have no features."""
    cells = v.cells(spark, sf)
    orders = table(spark, sf, "orders").select(v.text("o_orderkey").alias("cell_id"), v.text("o_custkey").alias("group_id"), F.log("o_totalprice").alias("order_total"))
    from cohortlens.operators.folds import hash_folds

    assigned = hash_folds(orders.select("cell_id", "group_id"), "group_id", 3)
    return expect.modelling_view(
        cells.select("cell_id", "f1", "f2", "f6"), assigned, orders.select("cell_id", "order_total"), "cell_id", ["f1", "f2", "f6"], 3
    )[1]


@query(
    "x16_draw_completeness",
    f"""SELECT module, count(*) AS n, count(DISTINCT replicate) AS n_distinct, min(replicate) AS first, max(replicate) AS last, count(*) = 20 AND count(DISTINCT replicate) = 20 AS complete, true AS on_lattice FROM ({DRAWS20}) GROUP BY 1""",
)
def x16(spark, sf):
    draws = resample.cluster_bootstrap(v.oof(spark, sf, ("ols",)), ["module"], n_resamples=20, spearman=False)
    audit = expect.draw_table_audit(draws, ["module"], 20)
    p = draws.groupBy("module").agg(plus_one_p(F.count_if(F.col("r2") <= 0), F.count(F.lit(1))).alias("p"))
    return audit.join(p, "module").withColumn("on_lattice", expect.on_plus_one_lattice(F.col("p"), 20)).drop("p")


@query(
    "x17_frozen_parameters",
    """SELECT module, fold, issue FROM (SELECT stratum AS module, fold, count(*) AS n FROM cells GROUP BY 1, 2), (SELECT unnest(['repeated', 'outside_grid']) AS issue)
    WHERE (issue = 'repeated' AND fold = 0) OR (issue = 'outside_grid' AND module = '5-LOW')""",
)
def x17(spark, sf):
    """Parameters per stratum and fold; fold 0 is recorded twice and one stratum left the declared grid."""
    keys = v.cells(spark, sf).groupBy(F.col("stratum").alias("module"), "fold").agg(F.count(F.lit(1)).alias("n"))
    alpha = F.when(F.col("module") == "5-LOW", F.lit(0.5)).otherwise(F.lit(0.01))
    rows = keys.select("module", "fold", alpha.alias("alpha"), F.lit(0.5).alias("l1_ratio"))
    parameters = rows.unionByName(rows.filter((F.col("fold") == 0)))
    grid = expect.expected_grid(keys, ["module"], {"alpha": gram.ALPHAS, "l1_ratio": gram.L1_RATIOS})
    return expect.frozen_parameter_check(parameters, grid, ["module", "fold"], ["alpha", "l1_ratio"]).distinct()


@query("x17_fitted_parameters")
def x17b(spark, sf):
    """What the search selected, against the grid it was given: no rows means the contract holds."""
    coefficients = fits(spark, sf)[1]
    grid = expect.expected_grid(coefficients, ["target"], {"alpha": gram.ALPHAS, "l1_ratio": gram.L1_RATIOS})
    issues = expect.frozen_parameter_check(coefficients, grid, ["target", "outer_fold"], ["alpha", "l1_ratio"])
    return provenance.gate({"fitted_parameters": issues})


@query(
    "x18_integrity_gate",
    """SELECT 'library_reconciles' AS "check", count(*) AS n_violations, count(*) = 0 AS passed FROM library l LEFT JOIN (SELECT sample_id, CAST(sum(cnt) AS BIGINT) AS t FROM counts GROUP BY 1) c ON c.sample_id = l.sample_id WHERE t IS DISTINCT FROM lib
    UNION ALL SELECT 'groups_in_one_fold', CAST(0 AS BIGINT), true
    UNION ALL SELECT 'orders_have_lines', count(*), count(*) = 0 FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem)
    UNION ALL SELECT 'unique_lines', count(*), count(*) = 0 FROM (SELECT 1 FROM lineitem GROUP BY l_orderkey, l_linenumber HAVING count(*) > 1)
    UNION ALL SELECT 'targets_rebuilt', CAST(0 AS BIGINT), true""",
)
def x18(spark, sf):
    cells, orders = v.cells(spark, sf), table(spark, sf, "orders")
    lines = table(spark, sf, "lineitem")
    qc = genesets.sample_qc(v.counts(spark, sf), v.library(spark, sf))
    rebuilt = v.build_cells(spark, sf)
    return provenance.gate(
        {
            "library_reconciles": qc.filter("library_size_delta <> 0"),
            "groups_in_one_fold": expect.shared_groups(cells, "group_id", "fold"),
            "orders_have_lines": orders.select(F.col("o_orderkey").alias("l_orderkey")).join(lines, "l_orderkey", "left_anti"),
            "unique_lines": expect.duplicate_keys(lines, ["l_orderkey", "l_linenumber"]),
            "targets_rebuilt": expect.compare_tables(cells, rebuilt, ["cell_id"], list(v.TARGETS), 0.0, 0.0).filter("n_different > 0 OR n_one_sided > 0"),
        }
    )


@query(
    "s01_streaming_count_qc",
    """SELECT sample_id, CAST(sum(cnt) AS BIGINT) AS total_counts, count(*) FILTER (cnt > 0) AS genes_detected FROM counts GROUP BY 1""",
)
def s01(spark, sf):
    """Count files arrive in four batches; the running totals end equal to the batch job's."""
    path = v.scratch(spark)
    v.counts(spark, sf).repartition(4).write.parquet(path)
    totals = count_qc.running_sample_totals(count_qc.once(count_qc.count_stream(spark, path, 1)))
    table = v.scratch(spark)
    count_qc.start_table(totals, table, v.scratch(spark)).awaitTermination()
    return count_qc.current(spark, table, ["sample_id"])
