import math

import numpy as np
import pytest
from brute import spearman
from pyspark.sql import functions as F

from cohortlens.operators import corr, genesets, matching, reliability

COUNTS = [("s1", "A", 1), ("s1", "B", 2), ("s2", "A", 4), ("s2", "Req", 1)]


@pytest.fixture(scope="module")
def small(spark):
    counts = spark.createDataFrame(COUNTS, "sample_id string, gene string, cnt bigint")
    library = spark.createDataFrame([("s1", 3), ("s2", 5)], "sample_id string, lib bigint")
    return counts, library


def test_sample_qc_totals_and_reconciliation(spark, small):
    counts, library = small
    rows = {r["sample_id"]: r for r in genesets.sample_qc(counts, library).collect()}
    assert [rows[s]["total_counts"] for s in ("s1", "s2")] == [3, 5] and [rows[s]["genes_detected"] for s in ("s1", "s2")] == [2, 2]
    off = library.withColumn("lib", F.col("lib") + F.when(F.col("sample_id") == "s1", 1).otherwise(0))
    report = genesets.library_reconciliation(genesets.sample_qc(counts, off)).first()
    assert (report["n_mismatched"], report["max_abs_delta"]) == (1, 1)


def test_gene_qc_counts_zeros_and_gives_the_last_reason(spark, small):
    counts, library = small
    membership = spark.createDataFrame([("M", "Req")], "module string, gene string")
    catalog = spark.createDataFrame([("A",), ("B",), ("Req",), ("never",), (" pad",), ("B",)], "gene string")
    rows = {r["gene"]: r for r in genesets.gene_qc(counts, library, membership, catalog=catalog).collect()}
    x = [math.log2(1 / 3 * 1e6 + 1), math.log2(4 / 5 * 1e6 + 1)]
    assert rows["A"]["mean_log2cpm"] == pytest.approx(np.mean(x)) and rows["A"]["variance_log2cpm"] == pytest.approx(np.var(x))
    assert rows["A"]["candidate_eligible"] and rows["B"]["detection_rate"] == 0.5
    assert [rows[g]["exclusion_reason"] for g in ("B", "Req", "never", " pad")] == [
        "duplicate_symbol", "primary_module_gene", "zero_variance", "zero_variance",
    ]
    assert rows["Req"]["variance_log2cpm"] == pytest.approx(np.var([0, math.log2(1 / 5 * 1e6 + 1)]))


def dense_frame(spark, samples=60, genes=7, seed=4):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(samples, genes)) + rng.normal(size=(samples, 1))
    rows = [(f"s{i:02d}", "M", f"g{j}", 1, float(x[i, j])) for i in range(samples) for j in range(genes)]
    return x, spark.createDataFrame(rows, "sample_id string, module string, gene string, cnt bigint, x double")


def test_first_component_equals_numpy(spark):
    x, dense = dense_frame(spark)
    z = (x - x.mean(0)) / x.std(0)
    _, _, vt = np.linalg.svd(z - z.mean(0), full_matrices=False)
    v = vt[0] if (z @ vt[0]) @ z.mean(1) > 0 else -vt[0]
    standardised = genesets.standardised_members(dense)
    loadings = genesets.first_components(standardised)
    got = {r["gene"]: r for r in loadings.collect()}
    assert [got[f"g{j}"]["loading"] for j in range(7)] == pytest.approx(list(v))
    values = np.linalg.svd(z, compute_uv=False) ** 2
    assert got["g0"]["explained_ratio"] == pytest.approx(values[0] / values.sum())
    scores = {r["sample_id"]: r for r in genesets.target_definitions(standardised, loadings).collect()}
    assert scores["s05"]["pc1"] == pytest.approx(z[5] @ v) and scores["s05"]["zmean"] == pytest.approx(z[5].mean())


def test_control_targets_are_weighted_sums_with_zeros(spark, small):
    counts, library = small
    sets = spark.createDataFrame([("M", 0, "A", 0.5), ("M", 0, "B", 0.5), ("M", 1, "Req", 1.0)], "module string, control_id int, gene string, weight double")
    y = {(r["sample_id"], r["control_id"]): r["y"] for r in genesets.control_targets(genesets.long_expression(counts, library), library, sets).collect()}
    assert len(y) == 4 and y["s1", 1] == 0.0
    assert y["s1", 0] == pytest.approx((math.log2(1 / 3 * 1e6 + 1) + math.log2(2 / 3 * 1e6 + 1)) / 2)
    assert genesets.incomplete_controls(sets, counts).isEmpty()
    assert genesets.incomplete_controls(sets.union(spark.createDataFrame([("M", 2, "gone", 1.0)], sets.schema)), counts).first()["control_id"] == 2


def gene_table(spark, candidates=40):
    rng = np.random.default_rng(0)
    rows = [("t1", 1.0, 0.5, False), ("t2", 1.2, 0.6, False)]
    rows += [(f"c{i:02d}", float(1.1 + 0.4 * rng.normal()), float(0.55 + 0.1 * rng.normal()), True) for i in range(candidates)]
    return rows, spark.createDataFrame(rows, "gene string, mean_log2cpm double, detection_rate double, candidate_eligible boolean")


def test_pools_equal_brute_force(spark):
    rows, table = gene_table(spark)
    membership = spark.createDataFrame([("M", "t1"), ("M", "t2"), ("M", "absent")], "module string, gene string")
    z = matching.standardised_genes(table)
    pools = matching.candidate_pools(z, membership, 0.8, 10).collect()
    c = np.array([r[1:3] for r in rows if r[3]])
    mean, sd = c.mean(0), c.std(0)
    names = [r[0] for r in rows if r[3]]
    for t in rows[:2]:
        d = np.sqrt((((c - mean) / sd - (np.array(t[1:3]) - mean) / sd) ** 2).sum(1))
        want = [n for _, n in sorted(zip(d, names)) if _ <= 0.8][:10]
        assert [r["gene"] for r in sorted((p for p in pools if p["target_gene"] == t[0]), key=lambda r: r["pool_rank"])] == want
    assert not matching.pool_shortfalls(z, membership, matching.candidate_pools(z, membership, 0.01, 10)).isEmpty()


def test_matched_sets_are_unique_repeatable_and_avoid_targets(spark):
    _, table = gene_table(spark)
    membership = spark.createDataFrame([("M", "t1"), ("M", "t2")], "module string, gene string")
    z = matching.standardised_genes(table)
    limits = dict(max_mean_distance=0.9, max_expression=0.6, max_detection=0.6)
    args = dict(n_controls=12, radius=0.9, neighbours=8, max_attempts=60, wave=3, **limits)
    a = matching.matched_sets(z, membership, **args).collect()
    b = matching.matched_sets(z.repartition(5), membership.repartition(2), **args).collect()
    assert len(a) == 12 and {r["set_signature"] for r in a} == {r["set_signature"] for r in b}
    assert len({r["set_signature"] for r in a}) == 12
    for r in a:
        genes = [q["gene"] for q in r["picks"]]
        assert len(set(genes)) == 2 and not set(genes) & {"t1", "t2"} and r["mean_distance"] <= 0.9
    again = matching.duplicate_signatures(spark.createDataFrame(a)).first()
    assert again["n_repeated_signatures"] == 0 and again["gate_ok"]


def test_first_control_keeps_a_contested_signature(spark):
    rows = [("M", 0, 1, "x"), ("M", 1, 0, "x"), ("M", 1, 2, "y"), ("M", 2, 0, "y"), ("M", 2, 5, "z")]
    df = spark.createDataFrame(rows, "module string, control_id int, proposal int, set_signature string")
    got = {r["control_id"]: r["set_signature"] for r in matching._settle(df).collect()}
    assert got == {0: "x", 1: "y", 2: "z"}


def test_partition_counts(spark):
    sets = [("a", f"g{i}") for i in range(6)] + [("b", f"g{i}") for i in range(7)] + [("c", f"g{i:02d}") for i in range(19)] + [("d", f"g{i:02d}") for i in range(24)]
    df = spark.createDataFrame(sets, "module string, gene string")
    parts = reliability.balanced_partitions(reliability.set_sizes(df, ["module"]), ["module"], 100).collect()
    n = {m: [r["mask"] for r in parts if r["module"] == m] for m in "abcd"}
    assert [len(n[m]) for m in "abcd"] == [10, 35, 100, 100] and all(len(set(v)) == len(v) for v in n.values())
    assert all(k.count("1") == 3 and k[0] == "1" for k in n["a"]) and all(k.count("1") == 12 and k[0] == "1" for k in n["d"])
    wide = spark.createDataFrame([("w", f"g{i:03d}") for i in range(150)], "module string, gene string")
    masks = [r["mask"] for r in reliability.balanced_partitions(reliability.set_sizes(wide, ["module"]), ["module"], 30).collect()]
    assert len(set(masks)) == 30 and all(len(k) == 150 and k.count("1") == 75 for k in masks)
    assert {r["method"] for r in parts if r["module"] in "ab"} == {"exhaustive"}


def test_split_half_equals_brute_force(spark):
    import itertools

    x, dense = dense_frame(spark, genes=6)
    samples = dense.select("sample_id").distinct()
    sets = dense.select("module", "gene").distinct()
    row = reliability.reliability(dense.select("sample_id", "gene", "x"), sets, samples, ["module"], 100).first()
    f = x.astype(np.float32).astype(float)
    rho = []
    for left in itertools.combinations(range(6), 3):
        if 0 in left:
            right = [i for i in range(6) if i not in left]
            rho.append(spearman(f[:, left].mean(1), f[:, right].mean(1)))
    assert row["partition_n"] == 10 and row["median_rho"] == pytest.approx(np.median(rho)) and row["min_rho"] == pytest.approx(min(rho))
    assert row["median_sb"] == pytest.approx(np.median([2 * r / (1 + r) for r in rho]))


def test_components_use_a_strict_threshold(spark):
    rng = np.random.default_rng(1)
    a, d = rng.permutation(12).astype(float), rng.permutation(12).astype(float)
    df = spark.createDataFrame([(float(a[i]), float(-a[i]), float(d[i]), float(a[i])) for i in range(12)], "a double, b double, c double, e double")
    got = {r["feature"]: r["component_id"] for r in corr.feature_components(df, ["a", "b", "c", "e"], 0.9).collect()}
    assert got == {"a": "C01", "b": "C01", "e": "C01", "c": "C02"}
    exact = {r["feature"]: r["component_size"] for r in corr.feature_components(df, ["a", "b"], 1.0 - 1e-12).collect()}
    assert exact == {"a": 2, "b": 2}


def test_long_chain_is_one_component(spark):
    n = 40
    nodes = spark.range(n).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("node"))
    edges = spark.range(n - 1).select(F.lpad(F.col("id").cast("string"), 3, "0").alias("a"), F.lpad((F.col("id") + 1).cast("string"), 3, "0").alias("b"))
    assert corr.connected_components(nodes, edges.filter("a <> '019'")).groupBy("label").count().count() == 2


def test_duplicates_respect_missing_values(spark):
    rows = [(1.0, 1.0, 1.0), (None, None, 2.0), (3.0, 3.0, 3.0), (4.0, 4.0, 4.0)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = corr.duplicate_columns(df, ["a", "b", "c"]).collect()
    assert [(r["feature_1"], r["feature_2"], r["n_complete"], r["n_missing"]) for r in got] == [("a", "b", 3, 1)]
    assert corr.duplicate_policy_violations(corr.duplicate_columns(df, ["a", "b"]), "b", "a").isEmpty()


def test_matrix_identities(spark):
    m = np.array([[1, 0.5, 0.2], [0.5, 1, 0.1], [0.2, 0.1, 1]])
    df = spark.createDataFrame([("v", str(i), str(j), float(m[i, j])) for i in range(3) for j in range(3)], "k string, i string, j string, v double")
    row = corr.matrix_summary(df, ["k"], "i", "j", "v").first()
    values = np.linalg.eigvalsh(m)[::-1]
    assert row["participation_ratio"] == pytest.approx(values.sum() ** 2 / (values**2).sum()) and row["max_asymmetry"] == 0
    got = [r["eigenvalue"] for r in corr.matrix_eigenvalues(df, "k", "i", "j", "v").orderBy("position").collect()]
    assert got == pytest.approx(list(values))


def test_numbers_are_never_cut(spark):
    from cohortlens.functions.text import numbered

    out = spark.range(1).select(*[numbered("C", F.lit(n), 2).alias(f"n{n}") for n in (1, 10, 100, 12345)]).first()
    assert list(out) == ["C01", "C10", "C100", "C12345"]


def test_partitions_are_drawn_until_there_are_enough(spark):
    from cohortlens.operators.reliability import balanced_partitions, set_sizes

    rows = [(f"s{n}", f"g{i:03d}") for n in (2, 5, 8, 9, 10, 21, 40) for i in range(n)]
    out = balanced_partitions(set_sizes(spark.createDataFrame(rows, "s string, gene string"), ["s"]), ["s"], 100).toPandas()
    found = out.groupby("s").agg(n=("mask", "nunique"), rows=("mask", "size"), ways=("max_partitions", "first"), method=("method", "first"))
    assert (found["n"] == found["rows"]).all() and (found["n"] == found["ways"].clip(upper=100)).all()
    assert ((found["ways"] <= 100) == (found["method"] == "exhaustive")).all()
    assert all(m.count("1") == len(m) // 2 for m in out["mask"])


def test_samples_with_equal_scores_tie_in_any_order_of_members(spark):
    values = {"s1": (0.1, 0.2, 0.3), "s2": (0.3, 0.2, 0.1), "s3": (0.2, 0.3, 0.1), "s4": (0.9, 0.4, 0.8), "s5": (0.0, 0.1, 0.05)}
    rows = [(s, "m", f"g{i}", 1, x) for s, xs in values.items() for i, x in enumerate(xs)]
    dense = spark.createDataFrame(rows, "sample_id string, module string, gene string, cnt long, x double").coalesce(1)
    got = {r.gene: r for r in genesets.module_dominance(dense).collect()}
    scores = [0.2, 0.2, 0.2, 0.7, 0.05]
    for i in range(3):
        loo = [round((sum(xs) - xs[i]) / 2, 6) for xs in values.values()]
        assert got[f"g{i}"].module_loo_spearman == pytest.approx(spearman(scores, loo), abs=1e-12)
