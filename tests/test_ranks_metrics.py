import math
import random

import numpy as np
import pytest
from brute import average_ranks, metrics as brute_metrics
from pyspark.sql import functions as F

from cohortlens.functions import numeric, rules, text
from cohortlens.functions.rng import hash32, stable_seed
from cohortlens.operators import metrics, ranks


def column(df, name):
    return [r[name] for r in df.collect()]


@pytest.mark.parametrize("buckets", [2, 4, 64])
def test_value_ranks_match_brute_force_on_any_number_of_ranges(spark, buckets):
    rng = random.Random(5)
    values = [rng.choice([1.5, 2.0, -3.0, 7.25, rng.random()]) for _ in range(200)]
    rows = [("a" if i % 3 else "b", i, v) for i, v in enumerate(values)] + [("a", 900, float("nan")), ("a", 901, None)]
    df = spark.createDataFrame(rows, "g string, id int, v double").repartition(7)
    got = {r["id"]: r["r"] for r in ranks.value_ranks(df, ["g"], {"v": "r"}, buckets=buckets).collect()}
    for g in "ab":
        ids = [r[1] for r in rows if r[0] == g and r[2] is not None and not math.isnan(r[2])]
        expected = average_ranks([values[i] for i in ids])
        assert [got[i] for i in ids] == list(expected)
    assert got[900] is None and got[901] is None


def test_one_value_may_hold_most_rows(spark):
    df = spark.range(3000).select(F.lit("k").alias("g"), F.when(F.col("id") % 3 > 0, 5.0).otherwise(F.col("id").cast("double")).alias("v"))
    rows = ranks.cumulative_counts(df, ["g"], "v").collect()
    hot = [r for r in rows if r["v"] == 5.0][0]
    assert hot["n"] == 2000 and hot["n_total"] == 3000 and hot["n_before"] == sum(1 for i in range(0, 3000, 3) if i < 5)


def test_quantiles_are_linear_interpolated_and_weighted(spark):
    values = [3.0, 1.0, 10.0, 4.0, 4.0, 8.5, -2.0]
    df = spark.createDataFrame([("g", v, 1 + i % 3) for i, v in enumerate(values)], "g string, v double, w int")
    probs = {"a": 0.0, "b": 0.1, "c": 0.5, "d": 0.975, "e": 1.0}
    row = ranks.exact_quantiles(df, ["g"], "v", probs).first()
    assert [row[k] for k in probs] == pytest.approx([np.quantile(values, q) for q in probs.values()])
    repeated = np.repeat(values, [1 + i % 3 for i in range(len(values))])
    row = ranks.exact_quantiles(df, ["g"], "v", probs, weight="w").first()
    assert [row[k] for k in probs] == pytest.approx([np.quantile(repeated, q) for q in probs.values()])


def test_ordered_index_is_a_permutation_whatever_the_partitioning(spark):
    df = spark.range(500).select((F.col("id") % 2).alias("g"), F.col("id"), (F.col("id") % 7).alias("k"))
    a = ranks.ordered_index(df.repartition(5), ["g"], -F.col("k"), ["id"], "p", "n").collect()
    b = ranks.ordered_index(df.repartition(1), ["g"], -F.col("k"), ["id"], "p", "n", buckets=32).collect()
    assert {(r["id"], r["p"]) for r in a} == {(r["id"], r["p"]) for r in b}
    for g in (0, 1):
        rows = sorted((r for r in a if r["g"] == g), key=lambda r: r["p"])
        assert [r["p"] for r in rows] == list(range(250)) and {r["n"] for r in rows} == {250}
        assert [(-r["k"], r["id"]) for r in rows] == sorted((-r["k"], r["id"]) for r in rows)
    h = ranks.ordered_index(df, ["g"], hash32(1, F.col("id")), ["id"], "p", hashed=True).collect()
    assert sorted(r["p"] for r in h if r["g"] == 0) == list(range(250))


def test_top_fraction_breaks_ties_by_text_id(spark):
    rows = [("m", str(i), 1.0 if i < 40 else 2.0) for i in range(70)]
    df = spark.createDataFrame(rows, "m string, id string, s double")
    got = sorted(column(ranks.top_fraction(df, ["m"], "s", "id", 0.1), "id"))
    expected = [r[1] for r in sorted(rows, key=lambda r: (-r[2], r[1]))][: math.ceil(0.1 * 70)]
    assert got == sorted(expected)


def test_bh_by_hand(spark):
    p = [0.01, 0.04, 0.03, 0.002, 0.5]
    df = spark.createDataFrame([("f", str(i), v) for i, v in enumerate(p)], "f string, t string, p double")
    rows = sorted(ranks.bh_family(df, ["f"], "p", ["t"], 0.05, "five").collect(), key=lambda r: r["t"])
    assert [r["bh_q"] for r in rows] == pytest.approx([0.025, 0.05, 0.05, 0.01, 0.5])
    assert [r["rejected"] for r in rows] == [True, True, True, True, False]
    assert ranks.bh_input_violations(df, ["f"], "p", 5).isEmpty()
    broken = df.union(spark.createDataFrame([("f", "9", float("nan"))], df.schema))
    assert ranks.bh_input_violations(broken, ["f"], "p", 6).first()["n_bad"] == 1


def test_metrics_by_hand(spark):
    df = spark.createDataFrame([("m", 0.0, 0.0), ("m", 1.0, 1.0), ("m", 2.0, 1.0), ("m", 3.0, 4.0), ("m", float("nan"), 9.0), ("one", 1.0, 2.0)], "module string, y_true double, y_pred double")
    rows = {r["module"]: r for r in metrics.regression_metrics(df, ["module"]).collect()}
    expected = brute_metrics([0, 1, 2, 3], [0, 1, 1, 4])
    for k, want in expected.items():
        assert rows["m"][k] == pytest.approx(want)
    assert rows["m"]["mae"] == 0.5 and rows["m"]["rmse"] == pytest.approx(math.sqrt(0.5)) and rows["m"]["n"] == 5
    assert all(rows["one"][k] is None for k in expected)


def test_constant_prediction_has_no_correlation(spark):
    df = spark.createDataFrame([("m", float(i), 2.0) for i in range(5)], "module string, y_true double, y_pred double")
    row = metrics.regression_metrics(df, ["module"]).first()
    assert row["spearman"] is None and row["r2"] == pytest.approx(0.0)


def test_calibration_recovers_line(spark):
    rows = [("m", f"c{i:02d}", 1.5 * i + 2.0, float(i)) for i in range(20)]
    df = spark.createDataFrame(rows, "module string, cell_id string, y_true double, y_pred double")
    row = metrics.calibration(df, ["module"], "cell_id").first()
    assert (row["slope"], row["intercept"], row["top_decile_n"], row["status"]) == (pytest.approx(1.5), pytest.approx(2.0), 2, "PASS")
    assert row["top_decile_observed_mean"] == pytest.approx(1.5 * 18.5 + 2)
    assert row["top_decile_mean_observed_percentile"] == pytest.approx((19 / 20 + 1) / 2)
    flat = df.withColumn("y_pred", F.lit(1.0))
    assert metrics.calibration(flat, ["module"], "cell_id").first()["reason"] == "zero_variance_or_range"


def test_specificity_counts_ties_both_ways(spark):
    controls = spark.createDataFrame([("m", i, float(i % 10)) for i in range(100)], "module string, control_id int, r2 double")
    observed = spark.createDataFrame([("m", 7.0)], "module string, observed double")
    row = metrics.specificity_summary(controls, observed, ["module"]).first()
    assert row["extreme_count"] == 30 and row["raw_p"] == pytest.approx(31 / 101) and row["observed_percentile"] == pytest.approx(80.0)
    assert row["control_p95"] == pytest.approx(np.quantile([i % 10 for i in range(100)], 0.95))


def test_early_stopping_follows_the_sequential_rule(spark):
    rng = random.Random(3)
    curves = {k: [rng.random() * 5 + 50 / (1 + i) for i in range(60)] for k in range(6)}
    curves[9] = [10.0 - 0.1 * i for i in range(60)]
    rows = [(k, i + 1, v) for k, values in curves.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "run int, step int, loss double")
    got = {r["run"]: r for r in ranks.early_stopping(df, "run", "step", "loss", 0.25, 8, chunk=7).collect()}
    for k, values in curves.items():
        best, at, stale, stop = float("inf"), 0, 0, len(values)
        for i, v in enumerate(values, 1):
            if v < best - 0.25:
                best, at, stale = v, i, 0
            else:
                stale += 1
            if stale >= 8:
                stop = i
                break
        assert (got[k]["best_step"], got[k]["stop_step"]) == (at, stop)
        assert got[k]["best_loss"] == best


@pytest.mark.parametrize("merged", [2, 512])
def test_early_stopping_over_segments(spark, merged):
    """Falling curves over many segments, gaps, repeated epochs, missing losses and steps below zero, by the plain rule."""
    rng = random.Random(8)
    rows = [("falling", i, 1e6 - i) for i in range(-300, 700)]
    rows += [("gap", i, 50.0 - i) for i in range(20)] + [("gap", i, -100.0 - i) for i in range(200, 220)]
    rows += [("holes", i, 90.0 - i) for i in range(0, 400, 6)] + [("holes", 401, 1.0), ("holes", 401, -900.0), ("holes", None, -1e9)]
    rows += [("late", 0, None), ("late", 3, None), ("late", 5, 2.0), ("late", 6, None), ("late", 7, 1.0), ("one", 4, 1.5), ("none", 1, None)]
    rows += [(f"walk{k}", i, sum(rng.random() for _ in range(4)) + 40 / (1 + i * k)) for k in range(1, 5) for i in range(150)]
    df = spark.createDataFrame(rows, "run string, step int, loss double")
    got = {r["run"]: r for r in ranks.early_stopping(df, "run", "step", "loss", 0.2, 7, chunk=16, merged=merged).collect()}
    assert set(got) == {r[0] for r in rows}
    for run, row in got.items():
        epochs = {}
        for _, i, v in (r for r in rows if r[0] == run and r[1] is not None):
            epochs[i] = min((x for x in (epochs.get(i), v) if x is not None), default=None)
        at = best = None
        for i in sorted(epochs):
            if at is None:
                at, best = i, epochs[i]
            elif i > at + 7:
                break
            elif best is None or (epochs[i] is not None and epochs[i] < best - 0.2):
                at, best = i, epochs[i]
        last = max(epochs)
        assert (row["best_step"], row["best_loss"], row["stop_step"], row["stopped_early"]) == (at, best, min(at + 7, last), at + 7 <= last), run
        assert row["n_steps"] == sum(r[0] == run for r in rows)
    assert ranks.early_stopping(df.limit(0), "run", "step", "loss", 0.2, 7).collect() == []
    with pytest.raises(ValueError):
        ranks.early_stopping(df, "run", "step", "loss", -0.1, 7)


def test_scalars(spark):
    df = spark.createDataFrame([("a b", 1.0), (" x", float("inf")), ("", float("nan")), ("t\tb", None)], "s string, x double")
    got = df.select(text.identifier_issue(F.col("s")).alias("i"), numeric.finite(F.col("x")).alias("x"), text.first_token(F.col("s")).alias("t")).collect()
    assert [r["i"] for r in got] == ["", "surrounding_whitespace", "empty", "control_character"]
    assert [r["x"] for r in got] == [1.0, None, None, None] and got[0]["t"] == "a"
    one = spark.range(1).select(
        hash32("a", 1).alias("h"), stable_seed("x", 1).alias("s"), stable_seed(1, "x").alias("s2"),
        numeric.choose(F.lit(6).cast("bigint"), F.lit(3).cast("bigint")).alias("c"),
        numeric.choose(F.lit(19).cast("bigint"), F.lit(9).cast("bigint")).alias("d"),
        numeric.spearman_brown(F.lit(-1.0)).alias("sb"), numeric.sign_tail_p(F.lit(10), F.lit(0), F.lit(10)).alias("p"),
    ).first()
    assert one["h"] == 225584429 and one["s"] != one["s2"] and one["c"] == 20 and one["d"] == math.comb(19, 9)
    assert one["sb"] is None and one["p"] == pytest.approx(2 / 11)


def test_rules(spark):
    rows = [(0.0, 0.0, 0.5), (-0.1, 0.0, 0.5), (0.06, 0.0, 0.5), (0.06, -0.06, 0.5), (0.0, 0.0, -0.1)]
    df = spark.createDataFrame(rows, "a double, b double, c double")
    got = column(df.select(rules.classify_omission(F.col("a"), F.col("b"), F.col("c")).alias("l")), "l")
    assert got == ["stable", "weakened", "stronger_after_omission", "mixed_or_partial", "weakened"]


def test_attribution_summaries(spark):
    rows = [(str(c), "m", c % 2, f, float((c + 1) * (i + 1) * (-1) ** c)) for c in range(10) for i, f in enumerate("abc")]
    long = spark.createDataFrame(rows, "cell_id string, module string, fold int, feature string, value double")
    stable = {r["feature"]: r for r in metrics.attribution_stability(long, top=2).collect()}
    assert [stable[f]["overall_rank"] for f in "cba"] == [1, 2, 3] and stable["c"]["stable_top"] and not stable["a"]["stable_top"]
    components = spark.createDataFrame([("a", "C1"), ("b", "C1"), ("c", "C2")], "feature string, component_id string")
    grouped = {r["component_id"]: r["mean_abs"] for r in metrics.grouped_attribution(long, components).collect()}
    per_fold = [np.mean([(c + 1) * 3 for c in range(10) if c % 2 == k]) for k in (0, 1)]
    assert grouped["C1"] == pytest.approx(np.mean(per_fold)) and grouped["C2"] == pytest.approx(np.mean(per_fold))


def test_top_fraction_with_long_common_prefixes(spark, monkeypatch):
    from cohortlens.operators import ranks

    monkeypatch.setattr(ranks, "TIED_ROWS", 3)
    ids = [f"customer_{'é' * (i % 3)}{i:05d}" for i in range(200)] + ["customer_", "c"]
    rows = [("k", i, 1.0 if n % 5 else 2.0) for n, i in enumerate(ids)] + [("m", i, 0.0) for i in ids[:50]]
    df = spark.createDataFrame(rows, "g string, id string, s double")
    out = ranks.top_fraction(df, ["g"], "s", "id", 0.37).collect()
    for g in "km":
        own = sorted(((-s, i.encode()) for k, i, s in rows if k == g))
        want = {i for _, i in own[: -(-len(own) * 37 // 100)]}
        assert {r.id.encode() for r in out if r.g == g} == want


def test_ranges_do_not_depend_on_the_order_rows_arrive_in(spark):
    rows = spark.range(400_000).select(F.lit("k").alias("g"), (F.xxhash64("id") % 1_000_003).alias("v"), F.col("id"), F.lit(1).cast("bigint").alias("w"))
    orders = [rows.orderBy("id"), rows.orderBy(F.desc("v")), rows.repartition(13, "v").sortWithinPartitions("v")]
    fractions = [i / 64 for i in range(1, 64)]
    cuts = [ranks._with_ranges(o, ["g"], "v", "w", 64, ["id"]).groupBy("_range").agg(F.min("v").alias("low"), F.max("v").alias("high"), F.count("v").alias("n")) for o in orders]
    first, *others = [sorted(map(tuple, c.collect())) for c in cuts]
    assert len(first) == len(fractions) + 1 and all(o == first for o in others)
    assert max(r[3] for r in first) < 3 * 400_000 / 64


def test_short_curves_by_the_thousand_stop_as_one_by_one(spark):
    rng = random.Random(11)
    curves = {run: [rng.random() for _ in range(rng.randrange(1, 12))] for run in range(12_000)}
    rows = [(run, i + 1, x) for run, losses in curves.items() for i, x in enumerate(losses)]
    df = spark.createDataFrame(rows, "run long, step long, loss double")
    stopped = ranks.early_stopping(df, "run", "step", "loss", 0.1, 3, chunk=5)
    got = {r.run: (r.best_step, r.best_loss) for r in stopped.collect()}
    assert "FlatMapGroupsInPandas" not in stopped._jdf.queryExecution().executedPlan().toString()
    for run, losses in curves.items():
        hit = 0
        for i, x in enumerate(losses):
            if i - hit <= 3 and x < losses[hit] - 0.1:
                hit = i
            elif i - hit > 3:
                break
        assert got[run] == (hit + 1, losses[hit])
