"""Linear models for any number of fold assignments, strata and restricted cohorts from one scan of the rows.

Sums of products are kept per (group, stratum, ... , target). Groups stay whole in every split, so any assignment of
groups to folds, any stratum on its own and any cohort made of the kept keys is a sum of those rows; the rows themselves
are read once, when the cube is built. Predictors and targets are taken about their means, so that large means cost
no digits. Medians for imputation come from value counts per the same keys.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numeric import finite
from cohortlens.functions.rng import hash32
from cohortlens.operators.gram import Design, _pairs, fit_folds, gram_performance, predict_folds
from cohortlens.operators.ranks import exact_quantiles, ordered_index


@dataclass(frozen=True)
class Centre:
    """Means over all rows, of the numeric predictors and of the targets."""

    x: tuple[float, ...]
    y: dict[str, float]


def centre_of(df: DataFrame, design: Design, targets: Sequence[str]) -> Centre:
    means = df.agg(*[F.avg(finite(F.col(c))) for c in (*design.numeric, *targets)]).first()
    values = [float(m or 0.0) for m in means]
    return Centre(tuple(values[: len(design.numeric)]), dict(zip(targets, values[len(design.numeric) :], strict=True)))


def _sizes(design: Design) -> tuple[int, list[tuple[int, int]]]:
    p = len(design.names) + len(design.nullable)
    return p, _pairs(p)


def group_sums(df: DataFrame, design: Design, targets: Sequence[str], keys: Sequence[str], centre: Centre) -> DataFrame:
    """One row per (keys, target): counts, sums and products over the rows whose target is finite."""
    p, pairs = _sizes(design)
    x = [F.coalesce(finite(F.col(c)) - F.lit(m), F.lit(0.0)) for c, m in zip(design.numeric, centre.x, strict=True)]
    x += design.columns()[len(design.numeric) :]  # strata and missing indicators
    ys = F.array(*[F.struct(F.lit(t).alias("target"), (finite(F.col(t)) - F.lit(centre.y[t])).alias("y")) for t in targets])
    rows = df.select(*keys, *[c.alias(f"_x{i}") for i, c in enumerate(x)], F.explode(ys).alias("_t"))
    rows = rows.select(*keys, *[f"_x{i}" for i in range(p)], "_t.target", F.col("_t.y").alias("_y")).filter(F.col("_y").isNotNull())
    y = F.col("_y")
    return rows.groupBy(*keys, "target").agg(
        F.count(y).alias("n"), F.sum(y).alias("sy"), F.sum(y * y).alias("syy"),
        *[F.sum(f"_x{i}").alias(f"s{i}") for i in range(p)],
        *[F.sum(F.col(f"_x{i}") * y).alias(f"c{i}") for i in range(p)],
        *[F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"p{i}_{j}") for i, j in pairs],
    )


def group_values(df: DataFrame, design: Design, keys: Sequence[str], centre: Centre) -> DataFrame:
    """(keys, feature, x, w): how often each value of the predictors that may be missing occurs, about the mean."""
    mean = dict(zip(design.numeric, centre.x, strict=True))
    wide = df.select(*keys, *[(finite(F.col(c)) - F.lit(mean[c])).alias(c) for c in design.nullable])
    long = wide.unpivot(list(keys), list(design.nullable), "feature", "x").filter(F.col("x").isNotNull())
    return long.groupBy(*keys, "feature", "x").agg(F.count(F.lit(1)).alias("w"))


def with_inner_masks(runs: DataFrame, design: Design, share: float = 0.2) -> DataFrame:
    """Adds mask to (run, group, fold, ...): bit k is set where the group validates inside outer fold k of its run."""
    group, folds = design.group, list(design.folds)
    training = runs.select("run", group, "fold").distinct().withColumn("outer_fold", F.explode(F.array(*map(F.lit, folds))))
    training = training.filter(F.col("fold") != F.col("outer_fold")).select("run", "outer_fold", group)
    placed = ordered_index(training, ["run", "outer_fold"], hash32(design.seed, F.col("outer_fold"), F.col(group)), [group], "_pos", "_groups", hashed=True)
    validates = F.col("_pos") < F.ceil(F.lit(share) * F.col("_groups"))
    bit = F.when(validates, F.pow(F.lit(2), F.col("outer_fold")).cast("int"))
    masks = placed.groupBy("run", group).agg(F.coalesce(F.sum(bit), F.lit(0)).cast("int").alias("mask"))
    return runs.join(masks, ["run", group], "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def _shared(table: DataFrame, runs: DataFrame) -> list[str]:
    return [c for c in runs.columns if c in table.columns and c not in ("run", "fold", "mask")]


def run_medians(values: DataFrame, runs: DataFrame, design: Design) -> DataFrame:
    """(run, medians): training medians per outer fold, feature and scope ('inner' leaves out validation groups)."""
    return _medians(values.join(runs, _shared(values, runs)).groupBy("run", "fold", "mask", "feature", "x").agg(F.sum("w").alias("w")), design)


def _medians(counted: DataFrame, design: Design) -> DataFrame:
    spread = counted.withColumn("outer_fold", F.explode(F.array(*map(F.lit, design.folds)))).filter(F.col("fold") != F.col("outer_fold"))
    scopes = F.when(F.expr("getbit(mask, outer_fold)") == 1, F.array(F.lit("full"))).otherwise(F.array(F.lit("full"), F.lit("inner")))
    keys = ["run", "outer_fold", "scope", "feature"]
    medians = exact_quantiles(spread.withColumn("scope", F.explode(scopes)), keys, "x", {"median": 0.5}, weight="w")
    return medians.groupBy("run").agg(F.collect_list(F.struct("outer_fold", "scope", "feature", "median")).alias("medians"))


def _solver_rows(flat: DataFrame, p: int, pairs: list[tuple[int, int]]) -> DataFrame:
    return flat.select(
        "run", F.concat_ws("@", "run", "target").alias("target"), "fold", "mask", F.col("n").alias("ny"), "sy", "syy",
        F.array(*[f"c{i}" for i in range(p)]).alias("sxy"), "n", F.array(*[f"s{i}" for i in range(p)]).alias("sx"),
        F.array(*[f"p{i}_{j}" for i, j in pairs]).alias("sxx"),
    )


def row_statistics(df: DataFrame, runs: DataFrame, design: Design, targets: Sequence[str], centre: Centre) -> DataFrame:
    """run_statistics for runs that are known beforehand: rows meet their folds and are summed where they lie.

    No cube is made, which has nearly as many rows as the table itself where groups hold few rows of one kind.
    """
    rows, keys = df.drop("fold", "mask").join(runs, _shared(df, runs)), ["run", "fold", "mask"]
    out = _solver_rows(group_sums(rows, design, targets, keys, centre), *_sizes(design))
    if not design.nullable:
        return out.withColumn("medians", F.lit(None).cast("array<struct<outer_fold:int,scope:string,feature:string,median:double>>"))
    return out.join(_medians(group_values(rows, design, keys, centre), design), "run", "left")


def run_statistics(sums: DataFrame, values: DataFrame | None, runs: DataFrame, design: Design) -> DataFrame:
    """What the solver needs, per (run, target, fold, mask), from the cube alone; target is written run@target.

    runs: (run, group, fold, mask) and any further keys of the cube by which a run picks its rows.
    """
    p, pairs = _sizes(design)
    flat = [c for c in sums.columns if c in {"n", "sy", "syy"} or c[0] in "scp" and c[1:2].isdigit()]
    joined = sums.join(runs, _shared(sums, runs)).groupBy("run", "target", "fold", "mask").agg(*[F.sum(c).alias(c) for c in flat])
    out = _solver_rows(joined, p, pairs)
    if values is None or not design.nullable:
        none = F.lit(None).cast("array<struct<outer_fold:int,scope:string,feature:string,median:double>>")
        return out.withColumn("medians", none)
    return out.join(run_medians(values, runs, design), "run", "left")


def split_run(table: DataFrame) -> DataFrame:
    """run@target back into run and target; a run's name may hold the sign, a target's may not."""
    return table.withColumn("run", F.regexp_replace("target", "@[^@]*$", "")).withColumn("target", F.element_at(F.split("target", "@"), -1))


def uncentred(coefficients: DataFrame, design: Design, centre: Centre) -> DataFrame:
    """Coefficients for the rows as they are: (run, target, ...) with intercept, means and medians in the given units."""
    named = split_run(coefficients)
    own = F.lit(0.0)
    for t, m in centre.y.items():
        own = F.when(F.col("target") == t, F.lit(m)).otherwise(own)
    shift = [*centre.x, *[0.0] * len(design.levels)]
    moved = F.array(*map(F.lit, shift))
    nullable = F.array(*[F.lit(m if n in design.nullable else 0.0) for n, m in zip(design.names, shift, strict=True)])
    dot = F.aggregate(F.zip_with("coef", moved, lambda a, b: a * b), F.lit(0.0), lambda s, v: s + v)

    def plus(column: str, other: Column) -> Column:
        return F.zip_with(column, other, lambda a, b: a + b)

    return named.withColumns({"intercept": F.col("intercept") + own - dot, "x_mean": plus("x_mean", moved), "median": plus("median", nullable)})


def fit_runs(
    statistics: DataFrame, design: Design, centre: Centre, model: str, candidates: Sequence[tuple[float, float | None]], scale: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """(coefficients per run, target and outer fold; pooled n, R2 and RMSE per run and target) without reading a row.

    Columns frozen_alpha and frozen_l1 of statistics, if there, stand in for the candidates.
    """
    fitted = fit_folds(statistics, design, model, candidates, scale)
    return uncentred(fitted, design, centre), split_run(gram_performance(statistics, fitted, design))


def run_predictions(df: DataFrame, runs: DataFrame, coefficients: DataFrame, design: Design, targets: Sequence[str], keep: Sequence[str] = ("cell_id", "group_id", "stratum")) -> DataFrame:
    """(keep, run, fold, target, model, y_true, y_pred): out of fold, for every run that holds the row."""
    rows = df.drop("fold", "mask").join(runs.drop("mask"), _shared(df, runs))
    made = predict_folds(rows, coefficients, design, keep=[*keep, *targets], on=("run", "fold"))
    truth = F.coalesce(*[F.when(F.col("target") == t, F.col(t)) for t in targets])
    return made.select(*keep, "run", "fold", "target", "model", truth.alias("y_true"), "y_pred").filter(finite(F.col("y_true")).isNotNull())
