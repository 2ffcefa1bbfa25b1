import hashlib
import random

import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.operators import expect, profile, provenance
from cohortlens.sources import sinks, tables
from cohortlens.streaming import count_qc


def test_header_repair_needs_proof(spark, tmp_path):
    path = tmp_path / "meta.csv"
    path.write_text("id,Tree_first_cl_label,extra\n1,CS180626100018,Vip Gpc3\n2,CS9,Sst Chodl\n")
    schema = T.StructType([T.StructField(n, T.StringType()) for n in ("id", "Tree_first_cl_label", "extra")])
    good = tables.read_metadata(spark, str(path), schema, "Tree_first_cl_label", "extra")
    assert good.columns == ["id", "cluster_id", "cluster_label"]
    path.write_text("id,Tree_first_cl_label,extra\n1,Vip,CS1\n")
    with pytest.raises(ValueError):
        tables.read_metadata(spark, str(path), schema, "Tree_first_cl_label", "extra")


def test_wide_scan_keeps_totals_over_all_genes(spark):
    wide = spark.createDataFrame([("A", 1, 0), ("B", 2, 5)], "gene string, s1 int, s2 int")
    long = tables.wide_to_long(wide, "gene", ["s1", "s2"])
    asked = spark.createDataFrame([("A",)], "gene string")
    assert [tuple(r) for r in tables.selected_and_totals(long, asked).collect()] == [("s1", "A", 1, 3)]
    assert tables.invalid_counts(wide.withColumn("s2", F.lit(1.5)), "gene", ["s1", "s2"]).count() == 2


def test_control_set_json(spark, tmp_path):
    path = tmp_path / "sets.json"
    path.write_text('{"module": "M", "controls": [{"control_id": 0, "genes": ["a", "b"]}, {"control_id": 1, "genes": ["c"]}]}')
    rows = tables.read_control_sets(spark, str(path)).orderBy("control_id", "gene").collect()
    assert [(r["control_id"], r["gene"], r["weight"]) for r in rows] == [(0, "a", 0.5), (0, "b", 0.5), (1, "c", 1.0)]


def test_module_issues(spark):
    df = spark.createDataFrame([("M", ["a", "a", ""]), ("X", ["b"])], "module string, genes array<string>")
    got = {(r["module"], r["issue"]) for r in tables.module_issues(tables.module_membership(df), ["M"]).collect()}
    assert got == {("M", "repeated"), ("M", "empty"), ("X", "unexpected_module")}


def test_partition_overwrite_touches_only_its_partitions(spark, tmp_path):
    path = str(tmp_path / "facts")
    df = spark.createDataFrame([("a", 1), ("b", 2)], "module string, v int")
    sinks.write_partitions(df, path)
    sinks.write_partitions(df.filter("module = 'a'").withColumn("v", F.lit(9)), path, spread=2)
    assert {(r["module"], r["v"]) for r in spark.read.parquet(path).collect()} == {("a", 9), ("b", 2)}


def test_oof_audit_counts_every_defect(spark):
    rows = [("c1", "m", 1.0, 1.0), ("c1", "m", 1.0, 1.0), ("c2", "m", 1.0, float("nan")), ("zz", "m", 1.0, 1.0)]
    oof = spark.createDataFrame(rows, "cell_id string, module string, y_true double, y_pred double")
    cells = spark.createDataFrame([("c1",), ("c2",), ("c3",)], "cell_id string")
    row = expect.oof_audit(oof, cells, {"module": ["m"]}).first()
    assert (row["n_rows"], row["n_duplicated"], row["n_missing"], row["n_extra"], row["n_nonfinite"], row["exactly_once"]) == (4, 1, 1, 1, 1, False)


def test_oof_audit_meets_cells_without_a_join_of_all_rows(spark):
    levels = {"module": [f"m{i}" for i in range(3)], "feature": list(range(7))}  # more than one row of counts a cell
    cells = spark.range(40).select(F.concat(F.lit("c"), F.col("id")).alias("cell_id"))
    full = cells
    for name, values in levels.items():
        full = full.withColumn(name, F.explode(F.array(*map(F.lit, values))))
    full = full.withColumns({"y_true": F.lit(1.0), "y_pred": F.lit(2.0)})
    odd = [("c3", "m1", 6, 1.0, None), (None, "m0", 0, 1.0, 1.0), ("c1", "other", 6, 1.0, 1.0), ("c1", "other", 6, 1.0, 1.0), ("c2", None, 1, 1.0, 1.0)]
    rows = full.filter("not (cell_id = 'c9' and module = 'm2' and feature = 4)").unionByName(spark.createDataFrame(odd, "cell_id string, module string, feature int, y_true double, y_pred double"))
    made = expect.oof_audit(rows, cells.unionByName(spark.createDataFrame([(None,)], "cell_id string")), levels)
    plan = made._jdf.queryExecution().executedPlan().toString()
    assert "Join" not in plan
    got = {(r.module, r.feature): tuple(r)[2:] for r in made.collect()}
    usual = (40, 0, 1, 0, 0, False)  # the cell without an id is met by nothing
    special = {("m1", 6): (41, 1, 1, 0, 1, False), ("m0", 0): (41, 0, 1, 1, 0, False), ("m2", 4): (39, 0, 2, 0, 0, False), ("other", 6): (2, 1, 0, 1, 0, False), (None, 1): (1, 0, 0, 1, 0, False)}
    assert got == {(m, f): usual for m in levels["module"] for f in levels["feature"]} | special


def test_compare_and_identity(spark):
    a = spark.createDataFrame([(1, 1.0, None), (2, 2.0, 3.0)], "k int, x double, z double")
    b = spark.createDataFrame([(1, 1.0 + 1e-12, None), (2, 2.5, 3.0), (3, 0.0, 0.0)], "k int, x double, z double")
    got = {r["column"]: r for r in expect.compare_tables(a, b, ["k"], ["x", "z"]).collect()}
    assert got["x"]["n_different"] == 1 and got["x"]["n_one_sided"] == 1 and got["z"]["n_different"] == 0
    counts = {r["check"]: r["n_violations"] for r in expect.identity_audit(a, b, "k", ["z"]).collect()}
    assert counts == {"z": 0, "unmatched": 0}


def test_joins_and_grids(spark):
    left = spark.createDataFrame([(1, "a"), (1, "b"), (3, "c")], "k int, v string")
    right = spark.createDataFrame([(1, "x"), (2, "y"), (2, "z")], "k int, w string")
    _, bad = expect.checked_join(left, right, ["k"], validate="one_to_one")
    assert {(r["side"], r["k"]) for r in bad.collect()} == {("left", 1), ("right", 2)}
    sources = {(r["k"], r["source"]) for r in expect.outer_with_source(left, right, ["k"]).collect()}
    assert sources == {(1, "both"), (2, "right_only"), (3, "left_only")}
    grid = expect.expected_grid(left, ["k"], {"m": ["p", "q"]})
    diff = expect.two_way_difference(grid, grid.filter("m = 'p'"), ["k", "m"])
    assert {(r["k"], r["m"], r["side"]) for r in diff.collect()} == {(1, "q", "missing"), (3, "q", "missing")}
    with pytest.raises(ValueError):
        expect.drop_features(left, ["v"], ["nope"])


def test_modelling_view_rejects_target_among_predictors(spark):
    f = spark.createDataFrame([("c1", 1.0), ("c2", None)], "cell_id string, f double")
    folds = spark.createDataFrame([("c1", "g", 0), ("c2", "g", 7)], "cell_id string, group_id string, fold int")
    t = spark.createDataFrame([("c1", 1.0), ("c2", 2.0)], "cell_id string, y double")
    with pytest.raises(ValueError):
        expect.modelling_view(f, folds, t, "cell_id", ["y"], 3)
    view, checks = expect.modelling_view(f, folds, t, "cell_id", ["f"], 3)
    counts = {r["check"]: r["n"] for r in checks.collect()}
    assert view.count() == 2 and counts["null_f"] == 1 and counts["fold_out_of_set"] == 1 and counts["group_in_several_folds"] == 1


def test_manifest_digests_and_status(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    (tmp_path / "a.txt").write_bytes(b"hello")
    (tmp_path / "sub" / "b.bin").write_bytes(b"xyz")
    (tmp_path / "c.tmp").write_bytes(b"no")
    actual = provenance.artifact_manifest(spark, str(tmp_path), strip=str(tmp_path))
    rows = {r["path"]: r for r in actual.collect()}
    assert set(rows) == {"a.txt", "sub/b.bin"} and rows["a.txt"]["sha256"] == hashlib.sha256(b"hello").hexdigest()
    listed = [("a.txt", 5, "bad"), ("sub/b.bin", 9, "x"), ("gone", 1, "x"), ("../up", 1, "x"), ("twice", 1, "x"), ("twice", 1, "x")]
    recorded = spark.createDataFrame(listed, "path string, bytes bigint, sha256 string")
    got = {r["path"]: r["status"] for r in provenance.manifest_status(recorded, actual).collect()}
    assert got == {"a.txt": "digest_mismatch", "sub/b.bin": "size_mismatch", "gone": "missing", "../up": "unsafe_path", "twice": "duplicate_path"}


def test_validity_fails_closed(spark):
    truth = spark.createDataFrame([("m", "c1", 1.0), ("m", "c2", 2.0)], "module string, cell_id string, y_true double")
    wanted = spark.createDataFrame([("m", "sig")], "module string, run_signature string")
    good = [(0, "c1", 1.0, 0.5, "sig"), (0, "c2", 2.0, 0.5, "sig")]
    broken = {1: (1, "c1", 9.0, 0.5, "sig"), 2: (2, "c1", 1.0, float("nan"), "sig"), 3: (3, "c1", 1.0, 0.5, "old")}
    rows = good + [r for k in broken for r in (broken[k], (k, "c2", 2.0, 0.5, "sig"))] + [(4, "c1", 1.0, 0.5, "sig")]
    stored = spark.createDataFrame([("m", *r) for r in rows], "module string, control_id int, cell_id string, y_true double, y_pred double, run_signature string")
    expected = spark.createDataFrame([("m", k) for k in range(6)], "module string, control_id int")
    todo = provenance.work_list(expected, provenance.partition_validity(stored, truth, wanted), 2)
    assert sorted(r["control_id"] for r in todo.collect()) == [1, 2, 3, 4, 5]


def test_digests_ignore_order_and_see_changes(spark):
    df = spark.createDataFrame([("k", f"c{i}", float(i)) for i in range(20)], "g string, id string, v double")
    digest = lambda d: provenance.vector_digest(d, ["g"], "id", "v").first()["digest"]
    assert digest(df) == digest(df.repartition(7)) != digest(df.withColumn("v", F.when(F.col("id") == "c3", 3.0001).otherwise(F.col("v"))))
    one = spark.createDataFrame([(1, "x")], "b int, a string").select(provenance.config_digest(["b", "a"]).alias("d")).first()["d"]
    assert one == hashlib.sha256(b"a=x\nb=1").hexdigest()


def test_profiles(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 2.0), ("b", None), (None, 4.0)], "s string, x double")
    rows = {r["column"]: r for r in profile.column_profile(df, ["s", "x"]).collect()}
    assert rows["s"]["top_values"] == '{"a":2,"b":1}' and rows["s"]["n_missing"] == 1 and rows["x"]["n_distinct"] == 3
    row = profile.numeric_profile(df, ["x"]).first()
    assert (row["n"], row["n_missing"], row["median"], row["q1"]) == (3, 1, 2.0, 1.5)


def test_streamed_totals_equal_batch_totals(spark, tmp_path):
    rows = [(f"s{i % 4}", f"g{i}", i % 5) for i in range(60)]
    counts = spark.createDataFrame(rows, count_qc.COUNTS)
    path = str(tmp_path / "in")
    counts.repartition(3).write.parquet(path)
    stream = count_qc.count_stream(spark, path, 1)
    for build, name, key in ((count_qc.running_sample_totals, "samples", "sample_id"), (count_qc.running_gene_counts, "genes", "gene")):
        count_qc.start(build(stream), name, str(tmp_path / name)).awaitTermination()
        assert sorted(map(tuple, spark.table(name).collect())) == sorted(map(tuple, build(counts).collect()))


def test_every_query_is_registered_once_and_runs_small(spark, sf):
    from __spark_entry__ import entry, oracle_sql, queries

    names, sql = queries(), oracle_sql()
    assert len(names) > 125 and set(sql) <= set(names)
    assert entry(spark).count() == 3
    for name in ("b05_candidate_eligibility", "d06_regression_metrics", "x02_exactly_once", "i09_stratified_group_folds"):
        assert names[name](spark, sf).count() > 0


def test_stream_counts_a_repeated_file_once_and_goes_on_after_a_restart(spark, tmp_path):
    rows = [(f"s{i % 3}", f"g{i}", i % 4) for i in range(60)]
    path, table, state = (str(tmp_path / x) for x in ("in", "totals", "state"))

    def arrive(part):
        spark.createDataFrame(part, count_qc.COUNTS).coalesce(1).write.mode("append").parquet(path)

    def run():
        stream = count_qc.running_sample_totals(count_qc.once(count_qc.count_stream(spark, path, 1)))
        count_qc.start_table(stream, table, state).awaitTermination()
        return sorted(map(tuple, count_qc.current(spark, table, ["sample_id"]).collect()))

    def plain(part):
        held = {s: [c for t, _, c in part if t == s] for s, _, _ in part}
        return sorted((s, sum(c), sum(x > 0 for x in c)) for s, c in held.items())

    arrive(rows[:30])
    arrive(rows[:30])
    assert run() == plain(rows[:30])
    arrive(rows[20:])
    assert run() == plain(rows)
    assert run() == plain(rows)


@pytest.mark.parametrize("split", [1000, 4096, 50_000])
def test_large_files_are_hashed_in_blocks_wherever_they_are_split(spark, tmp_path, split):
    rng = random.Random(3)
    contents = {
        "noise.bin": rng.randbytes(70_001), "ends.bin": rng.randbytes(40_959) + b"\n", "lines.bin": b"\r\n\n" * 9_000, "few.bin": b"x" * 30_000 + b"\n" + b"y" * 9_000,
        "with blank%20+.bin": rng.randbytes(20_480), "small.bin": rng.randbytes(8_192), "packed.gz": rng.randbytes(9_000), "gone.bin.tmp": rng.randbytes(9_000),
    }
    for name, data in contents.items():
        (tmp_path / name).write_bytes(data)

    def digest(data, size=4096):
        return hashlib.sha256(b"".join(hashlib.sha256(data[i : i + size]).digest() for i in range(0, len(data), size))).hexdigest()

    usual = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", str(split))
    try:
        got = {r.path: (r.bytes, r.sha256) for r in provenance.artifact_manifest(spark, str(tmp_path), strip=str(tmp_path), whole=8_192, block=4096).collect()}
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", usual)
    plain = {n: hashlib.sha256(contents[n]).hexdigest() for n in ("small.bin", "packed.gz")}
    assert got == {n: (len(d), plain.get(n) or digest(d)) for n, d in contents.items() if not n.endswith(".tmp")}
