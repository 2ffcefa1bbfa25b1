"""Plans on tables too large to broadcast: what is joined to a few rows stays where it is."""

from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from cohortlens.operators import corr, gram, resample


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.fixture(scope="module")
def rows(spark):
    """Estimated at 48 MB, so that no side is small enough to broadcast unless its size is known."""
    n = spark.range(2_000_000)
    return n.select(
        F.col("id").alias("cell_id"), F.pmod("id", F.lit(50)).alias("group_id"), F.pmod("id", F.lit(4)).alias("stratum"),
        F.pmod("id", F.lit(3)).cast("int").alias("fold"), F.lit("m").alias("module"), F.pmod("id", F.lit(7)).cast("double").alias("f1"),
        F.pmod("id", F.lit(11)).cast("double").alias("f4"), F.pmod("id", F.lit(13)).cast("double").alias("y_true"),
    )


def test_simple_models_do_not_move_rows_to_their_fold(rows):
    made = [gram.mean_baseline(rows, ["module"]), gram.ols_oof(rows, ["module"], "f1"), gram.stratum_baseline(rows, ["module"], "stratum")]
    made += [gram.residualise(rows, ["module"], "y_true", ("f1", "f4")), corr.train_centred(rows, ["module"], "stratum", "y_true")]
    made.append(resample.centre_by_stratum(rows, ["module"], "stratum", ["y_true"]))
    for df in made:
        assert "SortMergeJoin" not in plan(df) and "Exchange hashpartitioning" not in plan(df)


def test_standardised_members_stay_where_they_are(rows):
    from cohortlens.operators import genesets

    dense = rows.select(F.col("cell_id").alias("sample_id"), "module", F.col("group_id").alias("gene"), F.col("y_true").alias("x"))
    made = plan(genesets.standardised_members(dense))
    assert "SortMergeJoin" not in made and "Exchange hashpartitioning" not in made


def test_ranks_move_every_row_once_per_column(rows):
    from cohortlens.operators import ranks

    made = plan(ranks.value_ranks(rows.select("module", "f1", "y_true"), ["module"], {"f1": "a", "y_true": "b"}))
    assert "SortMergeJoin" not in made and made.count("Exchange hashpartitioning") == 2


def test_a_hot_value_is_dealt_out_and_ranked_like_any_other(spark):
    from cohortlens.operators import ranks

    df = spark.range(0, 30_000, 1, 8).select("id", F.lit("g").alias("g"), F.when(F.col("id") < 20_000, 5.0).otherwise(F.col("id") % 10).alias("v"))
    got = {r.v: r.r for r in ranks.value_ranks(df, ["g"], {"v": "r"}).select("v", "r").distinct().collect()}
    assert got == {v: v * 1000 + 500.5 if v < 5 else 5000 + 10500.5 if v == 5 else v * 1000 + 20500.5 for v in map(float, range(10))}
    tasks = ranks.value_ranks(df, ["g"], {"v": "r"}).filter("v = 5").select(F.spark_partition_id().alias("p")).distinct().count()
    assert tasks > 1


def test_statistics_from_rows_equal_those_of_the_cube(spark):
    import numpy as np
    import pandas as pd

    from cohortlens.operators import cube
    from cohortlens.operators.gram import Design

    rng = np.random.default_rng(3)
    data = pd.DataFrame({"cell_id": range(300), "group_id": rng.integers(0, 40, 300).astype(str), "a": rng.normal(size=300), "b": rng.normal(size=300), "t": rng.normal(size=300)})
    df = spark.createDataFrame(data).withColumn("b", F.when(F.col("cell_id") % 7 > 0, F.col("b")))
    runs = spark.createDataFrame([(f"r{r}", str(g), (g + r * (g % 3)) % 3) for r in range(2) for g in range(40)], "run string, group_id string, fold int")
    design = Design(numeric=("a", "b"), nullable=("b",))
    runs, centre = cube.with_inner_masks(runs, design), cube.centre_of(df, design, ["t"])
    sums = cube.group_sums(df, design, ["t"], ["group_id"], centre)
    ways = [cube.row_statistics(df, runs, design, ["t"], centre), cube.run_statistics(sums, cube.group_values(df, design, ["group_id"], centre), runs, design)]
    one, other = ({(r.target, r.fold, r["mask"]): r for r in w.collect()} for w in ways)
    assert one.keys() == other.keys() and one
    for key, row in one.items():
        assert row.n == other[key].n and np.allclose(row.sxx, other[key].sxx) and np.allclose(row.sxy, other[key].sxy)
        assert sorted(row.medians) == sorted(other[key].medians)
