import hashlib
import math
import random

import numpy as np
import pytest
from brute import metrics as brute_metrics
from brute import spearman
from pyspark.sql import functions as F

from cohortlens.operators import expect, folds, resample


def oof_rows(seed=1, n=120, groups=15):
    rng = random.Random(seed)
    out = []
    for i in range(n):
        y = round(rng.gauss(0, 1), 1)
        g = 0 if i % 3 == 0 else rng.randrange(1, groups)
        out.append((f"c{i:03d}", f"g{g}", "AB"[i % 2], g % 3, "m", y, round(y * 0.5 + rng.gauss(0, 1), 1), round(rng.gauss(0, 1), 1)))
    return out


SCHEMA = "cell_id string, group_id string, stratum string, fold int, module string, y_true double, y_pred_a double, y_pred_b double"


def h32(*parts):
    return int(hashlib.md5("|".join(map(str, parts)).encode()).hexdigest()[:8], 16)


def weights(rows, n_resamples, seed):
    groups = sorted({r[1] for r in rows}, key=lambda g: (h32(seed, g), g))
    plans = []
    for r in range(n_resamples):
        picked = [groups[h32(seed, r, k) % len(groups)] for k in range(len(groups))]
        plans.append({g: picked.count(g) for g in groups})
    return plans


def test_cluster_bootstrap_equals_repeating_the_rows(spark):
    rows = oof_rows()
    df = spark.createDataFrame(rows, SCHEMA).withColumnRenamed("y_pred_a", "y_pred")
    got = {r["replicate"]: r for r in resample.cluster_bootstrap(df, ["module"], n_resamples=13, seed=7, batch=5).collect()}
    assert sorted(got) == list(range(13))
    for r, plan in enumerate(weights(rows, 13, 7)):
        y = [x[5] for x in rows for _ in range(plan[x[1]])]
        p = [x[6] for x in rows for _ in range(plan[x[1]])]
        want = brute_metrics(y, p)
        assert got[r]["n_sampled_rows"] == len(y)
        for k, value in want.items():
            assert got[r][k] == pytest.approx(value, abs=1e-9)


def test_paired_bootstrap_ignores_row_order_and_is_oriented(spark):
    df = spark.createDataFrame(oof_rows(), SCHEMA)
    a = resample.paired_bootstrap(df, ["module"], n_resamples=6, seed=3).collect()
    b = resample.paired_bootstrap(df.repartition(9).orderBy(F.rand(1)), ["module"], n_resamples=6, seed=3).collect()
    key = lambda r: (r["metric"], r["replicate"])
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        assert key(x) == key(y) and x["delta"] == pytest.approx(y["delta"], abs=1e-9)
        sign = -1 if x["metric"] in ("mae", "rmse") else 1
        assert x["delta"] == pytest.approx(sign * (x["metric_a"] - x["metric_b"]))
    summary = {r["metric"]: r for r in resample.paired_summary(spark.createDataFrame(a), ["module"]).collect()}
    assert summary["r2"]["count_gt0"] + summary["r2"]["count_lt0"] + summary["r2"]["count_eq0"] == 6


def test_paired_view_reports_differing_truth(spark):
    rows = []
    for model in ("a", "b"):
        for i in range(8):
            rows.append((f"c{i}", f"g{i % 3}", "s", i % 3, "m", model, 1.0 + i + (5 if model == "b" and i == 2 else 0), 1.0))
    oof = spark.createDataFrame(rows, "cell_id string, group_id string, stratum string, fold int, module string, model string, y_true double, y_pred double")
    view, bad = resample.paired_view(oof, "a", "b")
    assert view.count() == 7 and [(r["cell_id"], r["differs"]) for r in bad.collect()] == [("c2", "y_true")]


def test_stratified_permutation_matches_its_closed_form_and_keeps_strata(spark):
    df = spark.createDataFrame(oof_rows(), SCHEMA).withColumnRenamed("y_pred_a", "y_pred")
    null = resample.stratified_permutation(df, ["module"], "stratum", "cell_id", 300, 11)
    values = [r["rho"] for r in null.collect()]
    exact = resample.permutation_moments(df, ["module"], "stratum").first()
    assert len(values) == 300 and len(set(values)) > 250
    assert np.mean(values) == pytest.approx(exact["null_mean"], abs=4 * exact["null_sd"] / math.sqrt(300))
    assert np.std(values) == pytest.approx(exact["null_sd"], rel=0.2)
    again = resample.stratified_permutation(df.repartition(6), ["module"], "stratum", "cell_id", 300, 11)
    assert sorted(round(r["rho"], 9) for r in again.collect()) == sorted(round(v, 9) for v in values)
    observed = resample.observed_spearman(df, ["module"])
    row = resample.permutation_summary(null, observed, ["module"]).first()
    assert row["observed_spearman"] == pytest.approx(spearman([r[5] for r in oof_rows()], [r[6] for r in oof_rows()]))
    assert expect.draw_table_audit(null.withColumnRenamed("iteration", "replicate"), ["module"], 300).first()["complete"]


def test_folds_keep_groups_whole_and_strata_even(spark):
    rng = random.Random(2)
    rows = []
    for g in range(200):
        for _ in range(rng.randint(1, 8) if g else 400):
            rows.append((f"g{g}", "ABCD"[g % 4 if rng.random() < 0.9 else rng.randrange(4)], len(rows)))
    df = spark.createDataFrame(rows, "group_id string, stratum string, cell_id int")
    assigned = folds.stratified_group_folds(df, "group_id", "stratum", 3)
    assert assigned.count() == 200 and assigned.groupBy("group_id").count().filter("count > 1").isEmpty()
    joined = df.join(assigned.select("group_id", "fold"), "group_id")
    assert expect.shared_groups(joined, "group_id", "fold").isEmpty()
    small = joined.filter("group_id <> 'g0'")
    share = small.groupBy("fold").count().collect()
    assert max(r["count"] for r in share) - min(r["count"] for r in share) < 60
    repeats = folds.repeated_group_folds(df, "group_id", "stratum", 3, [1, 2])
    assert repeats.groupBy("repeat_seed").count().collect()[0]["count"] == 200
    grid = folds.fold_composition(joined, "stratum", [0, 1, 2]).collect()
    assert len(grid) == 12 and sum(r["n"] for r in grid) == len(rows)


def test_inner_split_takes_a_fifth_of_training_groups(spark):
    df = spark.createDataFrame([(f"g{i}", i % 3) for i in range(60)], "group_id string, fold int")
    split = folds.inner_group_split(df, "group_id", [0, 1, 2]).collect()
    for k in range(3):
        rows = [r for r in split if r["outer_fold"] == k]
        assert len(rows) == 40 and sum(r["is_validation"] for r in rows) == math.ceil(0.2 * 40)
        assert all(int(r["group_id"][1:]) % 3 != k for r in rows)
    masks = {r["group_id"]: r["mask"] for r in folds.inner_validation_mask(df, "group_id", [0, 1, 2]).collect()}
    for r in split:
        assert bool(masks[r["group_id"]] >> r["outer_fold"] & 1) == r["is_validation"]


def test_ledger_sees_a_leaking_group(spark):
    clean = spark.createDataFrame([(f"c{i}", f"g{i % 6}", i % 6 % 3) for i in range(12)], "cell_id string, group_id string, fold int")
    leaking = clean.union(spark.createDataFrame([("x", "g0", 1)], clean.schema))
    assert all(r["group_overlap"] == 0 for r in folds.leakage_ledger(clean, [0, 1, 2]).collect())
    assert {r["outer_fold"]: r["group_overlap"] for r in folds.leakage_ledger(leaking, [0, 1, 2]).collect()} == {0: 1, 1: 1, 2: 0}


def test_subset_is_chosen_without_outcomes(spark):
    df = spark.range(200).select(F.lit("m").alias("module"), F.col("id").alias("control_id"), F.rand(1).alias("r2"))
    a = folds.fixed_subset(df, ["module"], "control_id", 20)
    b = folds.fixed_subset(df.withColumn("r2", -F.col("r2")).repartition(5), ["module"], "control_id", 20)
    assert {r["control_id"] for r in a.collect()} == {r["control_id"] for r in b.collect()} and a.count() == 20


def test_groups_with_equal_rows_tie_in_any_order_of_rows(spark):
    ys = [1e6 + 0.1, -1e6 + 0.2, 0.3, 7e5 + 0.7]
    rows = [(f"{g}{i}", g, y) for g, order in (("a", ys), ("b", ys[::-1]), ("c", ys[2:] + ys[:2]), ("d", [5.0, 6.0, 1.0, 2.0])) for i, y in enumerate(order)]
    df = spark.createDataFrame(rows, "cell_id string, group_id string, y_true double").withColumns({"module": F.lit("m"), "stratum": F.lit("s"), "y_pred": F.col("y_true") / 3}).coalesce(1)
    got = {r.group_id: r for r in resample.group_level_means(df, ["module"], "group_id", "stratum").collect()}
    assert got["a"].y_true == got["b"].y_true == got["c"].y_true != got["d"].y_true
    assert got["a"].y_pred == got["b"].y_pred == got["c"].y_pred


def test_draws_are_never_broadcast(spark):
    rows = spark.range(3000).select(F.lit("m").alias("module"), F.col("id").cast("string").alias("group_id"), F.rand(1).alias("y_true"), F.rand(2).alias("y_pred"))
    draws = resample.cluster_bootstrap(resample.cut_lineage(rows), ["module"], n_resamples=50, spearman=False)
    draws.collect()
    plan = draws._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [slot" in plan and "BroadcastHashJoin [slot" not in plan
