"""Runs added up from a cube of group sums against fitting the rows of each run."""

import numpy as np
import pytest
from brute import elastic_net
from pyspark.sql import functions as F
from test_gram import DESIGN, SCHEMA, design_matrix, rows

from cohortlens.operators import cube, gram

KEYS = ("group_id", "stratum")
GRID = [(0.01, 0.5), (0.3, 0.9), (1.0, 0.1)]


@pytest.fixture(scope="module")
def data(spark):
    raw = rows()
    df = spark.createDataFrame(raw, SCHEMA).repartition(5).withColumn("u", F.when(F.col("e1") > 0, F.col("y") * 2 + 1e7))
    centre = cube.centre_of(df, DESIGN, ["y", "u"])
    sums = cube.group_sums(df, DESIGN, ["y", "u"], KEYS, centre)
    values = cube.group_values(df, DESIGN, KEYS, centre)
    return raw, df, centre, sums, values


def test_one_run_gives_what_the_rows_give(spark, data):
    """Selection, coefficients, predictions and errors of a run with the primary folds."""
    raw, df, centre, sums, values = data
    runs = cube.with_inner_masks(df.select(F.lit("a@b").alias("run"), "group_id", "fold").distinct(), DESIGN)
    statistics = cube.run_statistics(sums, values, runs, DESIGN)
    coefficients, errors = cube.fit_runs(statistics, DESIGN, centre, "en", GRID)
    oof, expected = gram.oof_linear(df, df.select("cell_id", F.lit("y").alias("target"), "y"), DESIGN, "en", GRID)
    ours = {r.outer_fold: r for r in coefficients.filter("target = 'y'").collect()}
    for r in expected.collect():
        own = ours[r.outer_fold]
        assert own.run == "a@b" and own.candidate == r.candidate and own.train_n == r.train_n
        for name in ("coef", "x_mean", "median", "coef_std"):
            assert np.allclose(own[name], r[name], atol=1e-7)
        assert own.intercept == pytest.approx(r.intercept, abs=1e-6)
    made = cube.run_predictions(df, runs, coefficients, DESIGN, ["y", "u"])
    got = {r.cell_id: r for r in made.filter("target = 'y'").collect()}
    want = {r.cell_id: r for r in oof.collect()}
    assert got.keys() == want.keys() and all(got[k].y_pred == pytest.approx(want[k].y_pred, abs=1e-6) for k in want)
    e = errors.filter("target = 'y'").first()
    y, p = np.array([want[k].y_true for k in want]), np.array([want[k].y_pred for k in want])
    assert e.n == len(raw) and e.rmse == pytest.approx(np.sqrt(np.mean((y - p) ** 2))) and e.r2 == pytest.approx(1 - ((y - p) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_strata_cohorts_and_frozen_parameters(spark, data):
    """Each stratum alone, other folds than the table's, a target that is missing and large on some rows."""
    raw, df, centre, sums, values = data
    folds = df.select(F.col("stratum").alias("run"), "stratum", "group_id").distinct().withColumn("fold", F.pmod(F.crc32(F.col("group_id").cast("binary")), F.lit(3)).cast("int"))
    runs = cube.with_inner_masks(folds, DESIGN)
    statistics = cube.run_statistics(sums, values, runs, DESIGN).withColumns({"frozen_alpha": F.lit(0.1), "frozen_l1": F.lit(0.5)})
    coefficients, _ = cube.fit_runs(statistics, DESIGN, centre, "en", [])
    made = cube.run_predictions(df, runs, coefficients, DESIGN, ["y", "u"]).collect()
    fold_of = {(r.stratum, r.group_id): r.fold for r in folds.collect()}
    fold = np.array([fold_of[r[2], r[1]] for r in raw])
    stratum, e1 = np.array([r[2] for r in raw]), np.array([r[4] for r in raw])
    y = {"y": np.array([r[7] for r in raw]), "u": np.array([r[7] * 2 + 1e7 for r in raw])}
    got = {(r.cell_id, r.run, r.target): r.y_pred for r in made}
    assert len(got) == len(raw) + int((e1 > 0).sum())
    for run in "ABC":
        for target in ("y", "u"):
            for k in range(3):
                # medians come from all rows of the run's training folds, whatever the target
                x = design_matrix(raw, (stratum == run) & (fold != k))
                usable = (e1 > 0) if target == "u" else np.ones(len(raw), bool)
                train = (stratum == run) & (fold != k) & usable
                w, b = elastic_net(x[train], y[target][train], 0.1, 0.5)
                for i in np.flatnonzero((stratum == run) & (fold == k) & usable):
                    assert got[raw[i][0], run, target] == pytest.approx(x[i] @ w + b, abs=2e-5)


def test_empty_cube(spark, data):
    _, df, _, _, _ = data
    none = df.filter("false")
    centre = cube.centre_of(none, DESIGN, ["y"])
    sums, values = cube.group_sums(none, DESIGN, ["y"], KEYS, centre), cube.group_values(none, DESIGN, KEYS, centre)
    runs = none.select(F.lit("r").alias("run"), "group_id", "fold", F.lit(0).alias("mask"))
    coefficients, errors = cube.fit_runs(cube.run_statistics(sums, values, runs, DESIGN), DESIGN, centre, "en", GRID)
    assert coefficients.count() == 0 and errors.count() == 0
