import numpy as np
import pytest
from brute import elastic_net
from pyspark.sql import functions as F

from cohortlens.operators import folds, gram


def rows(n=240, groups=40, seed=0):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 3)) * [1, 5, 0.2] + [0, 10, 3]
    y = x @ [1.0, 0.2, 0.0] + rng.normal(size=n)
    g = rng.integers(0, groups, n)
    missing = rng.random(n) < 0.15
    return [
        (f"c{i:03d}", f"g{g[i]}", "ABC"[int(g[i]) % 3], int(g[i]) % 3, float(x[i, 0]), None if missing[i] else float(x[i, 1]), float(x[i, 2]), float(y[i]))
        for i in range(n)
    ]


SCHEMA = "cell_id string, group_id string, stratum string, fold int, e1 double, e2 double, e3 double, y double"
DESIGN = gram.Design(("e1", "e2", "e3"), ("e2",))


@pytest.fixture(scope="module")
def data(spark):
    raw = rows()
    df = spark.createDataFrame(raw, SCHEMA).repartition(5)
    targets = df.select("cell_id", F.lit("t").alias("target"), "y")
    return raw, df, targets


def design_matrix(raw, train, onehot=False):
    x = np.array([[np.nan if v is None else v for v in r[4:7]] for r in raw])
    med = np.nanmedian(x[train], axis=0)
    x = np.where(np.isnan(x), med, x)
    if onehot:
        x = np.hstack([x, [[float(r[2] == s) for s in "ABC"] for r in raw]])
    return x


def test_fixed_elastic_net_equals_fitting_the_rows(data):
    raw, df, targets = data
    oof, coefficients = gram.oof_linear(df, targets, DESIGN, "en", [(0.1, 0.5)])
    got = {r["cell_id"]: r["y_pred"] for r in oof.collect()}
    y, fold = np.array([r[7] for r in raw]), np.array([r[3] for r in raw])
    for k in range(3):
        train = fold != k
        x = design_matrix(raw, train)
        w, b = elastic_net(x[train], y[train], 0.1, 0.5)
        for i in np.flatnonzero(fold == k):
            assert got[raw[i][0]] == pytest.approx(x[i] @ w + b, abs=1e-6)
    assert len(got) == len(raw) and coefficients.count() == 3


def test_ridge_with_strata_leaves_the_intercept_free(data):
    raw, df, targets = data
    design = gram.Design(("e1", "e2", "e3"), ("e2",), "stratum", ("A", "B", "C"))
    oof, _ = gram.oof_linear(df, targets, design, "ridge", [(1.0, None)])
    got = {r["cell_id"]: r["y_pred"] for r in oof.collect()}
    y, fold = np.array([r[7] for r in raw]), np.array([r[3] for r in raw])
    for k in range(3):
        train = fold != k
        x = design_matrix(raw, train, True)
        x[:, :3] = (x[:, :3] - x[train, :3].mean(0)) / x[train, :3].std(0)
        mean, ybar = x[train].mean(0), y[train].mean()
        a = (x[train] - mean).T @ (x[train] - mean) + np.eye(6)
        w = np.linalg.solve(a, (x[train] - mean).T @ (y[train] - ybar))
        for i in np.flatnonzero(fold == k):
            assert got[raw[i][0]] == pytest.approx((x[i] - mean) @ w + ybar, abs=1e-7)


def test_search_picks_the_candidate_of_least_inner_error(data):
    raw, df, targets = data
    grid = [(0.001, 0.5), (1.0, 0.9), (50.0, 0.5)]
    _, coefficients = gram.oof_linear(df, targets, DESIGN, "en", grid)
    split = {(r["outer_fold"], r["group_id"]): r["is_validation"] for r in folds.inner_group_split(df, "group_id", (0, 1, 2)).collect()}
    y, fold = np.array([r[7] for r in raw]), np.array([r[3] for r in raw])
    for row in coefficients.collect():
        k = row["outer_fold"]
        held = np.array([split.get((k, r[1]), False) for r in raw])
        train = (fold != k) & ~held
        x = design_matrix(raw, train)
        errors = []
        for a, l1 in grid:
            w, b = elastic_net(x[train], y[train], a, l1)
            errors.append(np.sqrt(np.mean((y[held] - x[held] @ w - b) ** 2)))
        assert row["candidate"] == int(np.argmin(errors)) and row["inner_rmse"] == pytest.approx(min(errors), abs=1e-6)


def test_performance_from_sums_equals_performance_from_rows(data):
    from cohortlens.operators.metrics import regression_metrics

    _, df, targets = data
    statistics = gram.fit_statistics(df, targets, DESIGN)
    coefficients = gram.fit_folds(statistics, DESIGN, "en", [(0.1, 0.5)])
    fast = gram.gram_performance(statistics, coefficients, DESIGN).first()
    oof, _ = gram.oof_linear(df, targets, DESIGN, "en", [(0.1, 0.5)])
    slow = regression_metrics(oof, ["module"], spearman=False).first()
    assert (fast["r2"], fast["rmse"], fast["n"]) == (pytest.approx(slow["r2"]), pytest.approx(slow["rmse"]), slow["n"])


def test_attributions_add_up_and_use_other_folds_only(data):
    _, df, targets = data
    oof, coefficients = gram.oof_linear(df, targets, DESIGN, "en", [(0.1, 0.5)])
    rebuilt = gram.linear_attributions(df, coefficients, DESIGN).groupBy("cell_id").agg((F.first("base") + F.sum("value")).alias("r"))
    worst = rebuilt.join(oof, "cell_id").agg(F.max(F.abs(F.col("r") - F.col("y_pred")))).first()[0]
    assert worst < 1e-9


def test_residuals_come_from_other_folds(data):
    raw, df, _ = data
    got = {r["cell_id"]: r for r in gram.residualise(df.withColumn("t", F.lit("t")), ["t"], "y", ("e1", "e3")).collect()}
    y, fold = np.array([r[7] for r in raw]), np.array([r[3] for r in raw])
    z = np.array([[1.0, r[4], r[6]] for r in raw])
    for k in range(3):
        b = np.linalg.lstsq(z[fold != k], y[fold != k], rcond=None)[0]
        for i in np.flatnonzero(fold == k):
            assert got[raw[i][0]]["residual"] == pytest.approx(y[i] - z[i] @ b, abs=1e-9)


def test_boosting_beats_the_mean(data):
    from cohortlens.operators.boost import boosted_oof
    from cohortlens.operators.metrics import regression_metrics

    _, df, _ = data
    out, chosen = boosted_oof(df, ["e1", "e2", "e3"], "y", [0, 1], "t", [{"maxIter": 5, "maxDepth": 2, "stepSize": 0.3}])
    assert regression_metrics(out, ["module"], spearman=False).first()["r2"] > 0.2 and len(chosen) == 2


def test_residual_targets_do_not_see_the_test_fold(spark):
    rng = np.random.default_rng(8)
    rows = [(str(i), "t", i % 3, float(rng.normal()), float(rng.normal()), float(rng.normal())) for i in range(60)]

    def residuals(data):
        df = spark.createDataFrame(data, "cell_id string, target string, fold int, y double, a double, b double")
        out = gram.residual_targets(df, ["target"], "y", ("a", "b")).filter("outer_fold = 0 AND fold <> 0").toPandas()
        return out.sort_values("cell_id")["residual"].to_numpy()

    moved = [(i, t, f, y + 100 * (f == 0) * (1 + a), a, b) for i, t, f, y, a, b in rows]
    assert np.allclose(residuals(rows), residuals(moved), atol=1e-9)


def test_coefficient_ranks_do_not_depend_on_units(spark):
    rng = np.random.default_rng(9)
    x = rng.normal(size=(90, 2))
    y = 3 * x[:, 0] + x[:, 1] + rng.normal(size=90) * 0.1

    def ranks_of(unit):
        df = spark.createDataFrame([(str(i), str(i), i % 3, float(a * unit), float(b)) for i, (a, b) in enumerate(x)], "cell_id string, group_id string, fold int, u double, v double")
        targets = spark.createDataFrame([(str(i), "t", float(v)) for i, v in enumerate(y)], "cell_id string, target string, y double")
        design = gram.Design(numeric=("u", "v"), folds=(0, 1, 2))
        fitted = gram.fit_folds(gram.fit_statistics(df, targets, design), design, "m", [(1e-6, None)])
        table = gram.coefficient_table(fitted, design).toPandas().sort_values(["fold", "feature"])
        return table["coef_rank"].tolist(), table["coef_std"].to_numpy()

    plain, scaled = ranks_of(1.0), ranks_of(0.001)
    assert plain[0] == scaled[0] == [1, 2] * 3
    assert np.allclose(plain[1], scaled[1], rtol=1e-4)
