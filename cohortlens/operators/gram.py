"""Leakage-safe linear models from one distributed aggregation.

A linear fit only needs sums of products. They are taken once per (fold, inner-validation mask),
and every training set (all folds but one, with or without its inner validation groups) is a sum of
those few rows. Median imputation enters through missing indicators, so it needs no second scan:
imputed x = x0 + missing * median. Only these small matrices reach the solver.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions.numeric import finite
from cohortlens.operators.folds import inner_validation_mask
from cohortlens.operators.ranks import exact_quantiles
from cohortlens.session import cut_lineage, measured

# Fixed values of the analyses: the elastic-net search grid.
ALPHAS = (0.001, 0.01, 0.1, 1.0)
L1_RATIOS = (0.1, 0.5, 0.9)


@dataclass(frozen=True)
class Design:
    """Predictors of a linear model: numeric columns, which of them may be missing, and strata."""

    numeric: tuple[str, ...] = ()
    nullable: tuple[str, ...] = ()
    stratum: str | None = None
    levels: tuple[str, ...] = ()
    folds: tuple[int, ...] = (0, 1, 2)
    group: str = "group_id"
    seed: int = 42
    names: tuple[str, ...] = field(init=False)

    def __post_init__(self) -> None:
        object.__setattr__(self, "names", (*self.numeric, *[f"{self.stratum}={v}" for v in self.levels]))

    def columns(self) -> list[Column]:
        """x0 of each predictor, then the missing indicators."""
        values = [F.coalesce(finite(F.col(c)), F.lit(0.0)) for c in self.numeric]
        dummies = [F.coalesce((F.col(self.stratum) == v).cast("double"), F.lit(0.0)) for v in self.levels]
        missing = [finite(F.col(c)).isNull().cast("double") for c in self.nullable]
        return values + dummies + missing


def _pairs(p: int) -> list[tuple[int, int]]:
    return [(i, j) for i in range(p) for j in range(i, p)]


def with_mask(df: DataFrame, design: Design) -> DataFrame:
    """Adds the inner-validation mask of each row's group."""
    masks = measured(inner_validation_mask(df, design.group, design.folds, seed=design.seed))
    return df.join(masks, design.group, "left").withColumn("mask", F.coalesce("mask", F.lit(0)))


def predictor_gram(df: DataFrame, design: Design, by: Sequence[str] = ("fold", "mask")) -> DataFrame:
    """One row per (fold, mask): n, sums and products of the augmented predictors."""
    xs = design.columns()
    named = df.select(*by, *[x.alias(f"_x{i}") for i, x in enumerate(xs)])
    singles = [F.sum(f"_x{i}").alias(f"_s{i}") for i in range(len(xs))]
    products = [F.sum(F.col(f"_x{i}") * F.col(f"_x{j}")).alias(f"_p{i}_{j}") for i, j in _pairs(len(xs))]
    sums = named.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *singles, *products)
    return sums.select(
        *by,
        "n",
        F.array(*[f"_s{i}" for i in range(len(xs))]).alias("sx"),
        F.array(*[f"_p{i}_{j}" for i, j in _pairs(len(xs))]).alias("sxx"),
    )


def target_moments(df: DataFrame, targets: DataFrame, design: Design, key: str = "cell_id") -> DataFrame:
    """One row per (target, fold, mask): sums of y, y*y and x*y. Thousands of targets share predictor_gram."""
    xs = design.columns()
    rows = df.select(key, "fold", "mask", *[x.alias(f"_x{i}") for i, x in enumerate(xs)]).join(
        targets.select(key, "target", "y"), key
    )
    sums = rows.groupBy("target", "fold", "mask").agg(
        F.count("y").alias("ny"),
        F.sum("y").alias("sy"),
        F.sum(F.col("y") * F.col("y")).alias("syy"),
        *[F.sum(F.col(f"_x{i}") * F.col("y")).alias(f"_c{i}") for i in range(len(xs))],
    )
    return sums.select(
        "target", "fold", "mask", "ny", "sy", "syy", F.array(*[f"_c{i}" for i in range(len(xs))]).alias("sxy")
    )


def training_medians(df: DataFrame, design: Design) -> DataFrame:
    """(outer_fold, scope, feature, median) over training rows; scope 'inner' leaves out validation groups.

    Values are counted per (fold, mask) first; only those counts are repeated per outer fold.
    """
    columns = list(design.nullable)
    long = (
        df.select("fold", "mask", *[finite(F.col(c)).alias(c) for c in columns])
        .unpivot(["fold", "mask"], columns, "feature", "x")
        .filter(F.col("x").isNotNull())
        .groupBy("fold", "mask", "feature", "x")
        .agg(F.count(F.lit(1)).alias("w"))
    )
    spread = long.withColumn("outer_fold", F.explode(F.array(*[F.lit(k) for k in design.folds]))).filter(
        F.col("fold") != F.col("outer_fold")
    )
    validates = F.expr("getbit(mask, outer_fold)") == 1
    scoped = spread.withColumn(
        "scope", F.explode(F.when(validates, F.array(F.lit("full"))).otherwise(F.array(F.lit("full"), F.lit("inner"))))
    )
    return exact_quantiles(scoped, ["outer_fold", "scope", "feature"], "x", {"median": 0.5}, weight="w").drop("n")


def fit_statistics(df: DataFrame, targets: DataFrame, design: Design, key: str = "cell_id") -> DataFrame:
    """Everything the solver needs: target moments joined to the predictor gram and the medians.

    The result has a few rows per target and is written out: fitting and scoring both read it.
    """
    masked = with_mask(df, design)
    gram = predictor_gram(masked, design)
    moments = target_moments(masked, targets, design, key).join(gram, ["fold", "mask"])
    if not design.nullable:
        none = F.lit(None).cast("array<struct<outer_fold:int,scope:string,feature:string,median:double>>")
        return cut_lineage(moments.withColumn("medians", none))
    packed = training_medians(masked, design).agg(
        F.collect_list(F.struct("outer_fold", "scope", "feature", "median"))
    )
    return cut_lineage(moments.withColumn("medians", packed.scalar()))


def _coordinate_descent(a: np.ndarray, b: np.ndarray, n: float, alpha: float, l1: float, sweeps: int = 5000) -> np.ndarray:
    """Minimises RSS/(2n) + alpha*(l1*|w| + (1-l1)/2*w^2) from the centred gram a and moments b."""
    w = np.zeros(len(b))
    ridge, lasso = n * alpha * (1 - l1), n * alpha * l1
    scale = np.diag(a) + ridge
    for _ in range(sweeps):
        step = 0.0
        for j in np.flatnonzero(scale > 0):
            rho = b[j] - a[j] @ w + a[j, j] * w[j]
            new = np.sign(rho) * max(abs(rho) - lasso, 0.0) / scale[j]
            step, w[j] = max(step, abs(new - w[j])), new
        if step <= 1e-10 * max(1.0, np.abs(w).max()):
            break
    return w


def _training_sums(rows: pd.DataFrame, p: int) -> dict:
    upper = np.triu_indices(p)
    products = np.zeros((p, p))
    products[upper] = np.sum(np.stack(rows["sxx"].to_numpy()), axis=0)
    products = products + np.triu(products, 1).T
    return {
        "n": float(rows["ny"].sum()),
        "sx": np.sum(np.stack(rows["sx"].to_numpy()), axis=0),
        "sxx": products,
        "sxy": np.sum(np.stack(rows["sxy"].to_numpy()), axis=0),
        "sy": float(rows["sy"].sum()),
        "syy": float(rows["syy"].sum()),
    }


def _imputed(sums: dict, lift: np.ndarray) -> dict:
    return {**sums, "sx": lift @ sums["sx"], "sxx": lift @ sums["sxx"] @ lift.T, "sxy": lift @ sums["sxy"]}


def _fit(sums: dict, numeric: int, alpha: float, l1: float | None, scale: bool) -> tuple[np.ndarray, float, np.ndarray, np.ndarray]:
    """Coefficients, intercept, feature means, and the coefficients on features scaled to unit spread."""
    n, mean, ybar = sums["n"], sums["sx"] / sums["n"], sums["sy"] / sums["n"]
    a = sums["sxx"] - n * np.outer(mean, mean)
    b = sums["sxy"] - n * mean * ybar
    unit, spread = np.ones(len(mean)), np.ones(len(mean))
    if numeric:
        sd = np.sqrt(np.clip(np.diag(a)[:numeric] / n, 0, None))
        unit[:numeric] = np.where(sd > 1e-12, sd, 1.0)
    if scale:
        spread = unit
    a, b = a / np.outer(spread, spread), b / spread
    if l1 is None:
        w = np.linalg.lstsq(a + alpha * np.eye(len(b)), b, rcond=None)[0]
    else:
        w = _coordinate_descent(a, b, n, alpha, l1)
    w = w / spread
    return w, float(ybar - w @ mean), mean, w * unit


def _rmse(sums: dict, w: np.ndarray, b0: float) -> float:
    n = sums["n"]
    sse = (
        sums["syy"]
        - 2 * (w @ sums["sxy"] + b0 * sums["sy"])
        + w @ sums["sxx"] @ w
        + 2 * b0 * (w @ sums["sx"])
        + n * b0 * b0
    )
    return float(np.sqrt(max(sse, 0.0) / n)) if n else float("inf")


COEFFICIENTS = (
    "target string, model string, outer_fold int, alpha double, l1_ratio double, inner_rmse double, "
    "candidate int, intercept double, coef array<double>, x_mean array<double>, median array<double>, train_n bigint, coef_std array<double>"
)


def fit_folds(statistics: DataFrame, design: Design, model: str, candidates: Sequence[tuple[float, float | None]], scale: bool = True) -> DataFrame:
    """Coefficients per (target, outer fold). With several candidates the inner split picks one by RMSE.

    Columns frozen_alpha and frozen_l1 of statistics, if there, give a target's one candidate instead.
    """
    names, nullable, numeric = list(design.names), list(design.nullable), len(design.numeric)
    p, width = len(names), len(names) + len(nullable)
    folds = list(design.folds)

    def lift(medians, fold: int, scope: str) -> np.ndarray:
        matrix = np.hstack([np.eye(p), np.zeros((p, width - p))])
        known = {(m["outer_fold"], m["scope"], m["feature"]): m["median"] for m in (medians if medians is not None else [])}
        for q, name in enumerate(nullable):
            matrix[names.index(name), p + q] = known.get((fold, scope, name), 0.0)
        return matrix

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        out, medians = [], rows["medians"].iloc[0]
        options = [(rows["frozen_alpha"].iloc[0], rows["frozen_l1"].iloc[0])] if "frozen_alpha" in rows else candidates
        for fold in folds:
            train = rows[rows["fold"] != fold]
            if train.empty:
                continue
            validates = (train["mask"].to_numpy() >> fold) & 1 == 1
            best, score = 0, None
            if len(options) > 1 and validates.any() and not validates.all():
                inner_lift = lift(medians, fold, "inner")
                fit_on = _imputed(_training_sums(train[~validates], width), inner_lift)
                check_on = _imputed(_training_sums(train[validates], width), inner_lift)
                scores = [_rmse(check_on, *_fit(fit_on, numeric, a, r, scale)[:2]) for a, r in options]
                best = int(np.argmin(scores))
                score = scores[best]
            alpha, l1 = options[best]
            full_lift = lift(medians, fold, "full")
            sums = _imputed(_training_sums(train, width), full_lift)
            w, b0, mean, scaled = _fit(sums, numeric, alpha, l1, scale)
            medians_out = [float(full_lift[i, p + nullable.index(c)]) if c in nullable else 0.0 for i, c in enumerate(names)]
            out.append(
                (rows["target"].iloc[0], model, fold, alpha, l1, score, best, b0, w.tolist(), mean.tolist(), medians_out, int(sums["n"]), scaled.tolist())
            )
        columns = [c.split()[0] for c in COEFFICIENTS.split(", ")]
        return pd.DataFrame(out, columns=columns)

    return statistics.groupBy("target").applyInPandas(solve, COEFFICIENTS)


def elastic_net_grid() -> list[tuple[float, float]]:
    return [(a, r) for a in ALPHAS for r in L1_RATIOS]


SALTS = 64


def _meet(rows: DataFrame, coefficients: DataFrame, on: Sequence[str] = ("fold",)) -> DataFrame:
    """Rows with the coefficients of their fold. Folds are few, so each is spread over 64 keys."""
    salted = coefficients.withColumnRenamed("outer_fold", "fold").withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    dealt = rows.withColumn("_salt", F.pmod(F.xxhash64(*rows.columns), F.lit(SALTS)).cast("int"))
    return dealt.join(salted, [*on, "_salt"]).drop("_salt")


def predict_folds(df: DataFrame, coefficients: DataFrame, design: Design, keep: Sequence[str] = ("cell_id", "group_id", "stratum"), on: Sequence[str] = ("fold",)) -> DataFrame:
    """Out-of-fold predictions: each row meets only coefficients fitted without its fold (and of its other keys in on)."""
    usable = [finite(F.col(c)) for c in design.numeric] + [
        F.coalesce((F.col(design.stratum) == v).cast("double"), F.lit(0.0)) for v in design.levels
    ]
    rows = df.select(*keep, *on, *[u.alias(f"_x{i}") for i, u in enumerate(usable)])
    joined = _meet(rows, coefficients, on)
    value = F.col("intercept")
    for i in range(len(usable)):
        value = value + F.col("coef")[i] * F.coalesce(F.col(f"_x{i}"), F.col("median")[i])
    return joined.select(*keep, *dict.fromkeys([*on, "target"]), "model", value.alias("y_pred"))


def oof_linear(
    df: DataFrame, targets: DataFrame, design: Design, model: str = "elastic_net",
    candidates: Sequence[tuple[float, float | None]] | None = None, scale: bool = True, key: str = "cell_id",
) -> tuple[DataFrame, DataFrame]:
    """(out-of-fold predictions with truth, coefficient table) for every target at once."""
    grid = list(candidates) if candidates is not None else elastic_net_grid()
    coefficients = measured(fit_folds(fit_statistics(df, targets, design, key), design, model, grid, scale))
    keep = [key, "group_id", "stratum"]
    rows = targets.select(key, "target", F.col("y").alias("y_true")).join(df, key)
    oof = predict_folds(rows, coefficients, design, keep=[*keep, "y_true"], on=("fold", "target"))
    return oof.withColumnRenamed("target", "module"), coefficients


def gram_performance(statistics: DataFrame, coefficients: DataFrame, design: Design) -> DataFrame:
    """Pooled out-of-fold R2 and RMSE per target without making a single prediction row.

    The squared error of fold k is a quadratic form of its own sums in the coefficients fitted without k.
    """
    names, nullable = list(design.names), list(design.nullable)
    p, width = len(names), len(names) + len(nullable)

    def evaluate(rows: pd.DataFrame) -> pd.DataFrame:
        n = sy = syy = sse = 0.0
        for fold, part in rows.groupby("fold"):
            first = part.iloc[0]
            lift = np.hstack([np.eye(p), np.zeros((p, width - p))])
            for q, name in enumerate(nullable):
                lift[names.index(name), p + q] = first["median"][names.index(name)]
            sums = _imputed(_training_sums(part, width), lift)
            sse += _rmse(sums, np.asarray(first["coef"]), first["intercept"]) ** 2 * sums["n"]
            n, sy, syy = n + sums["n"], sy + sums["sy"], syy + sums["syy"]
        sst = syy - sy * sy / n
        return pd.DataFrame(
            {
                "target": [rows["target"].iloc[0]],
                "n": [int(n)],
                "r2": [1 - sse / sst if sst > 0 else None],
                "rmse": [float(np.sqrt(sse / n))],
            }
        )

    fitted = coefficients.select("target", F.col("outer_fold").alias("fold"), "intercept", "coef", "median")
    return (
        statistics.drop("medians")
        .join(fitted, ["target", "fold"])
        .groupBy("target")
        .applyInPandas(evaluate, "target string, n bigint, r2 double, rmse double")
    )


def coefficient_table(coefficients: DataFrame, design: Design) -> DataFrame:
    """Long (module, model, fold, feature, coef, coef_std, abs_coef, coef_rank).

    Ranked by size on features scaled to unit spread in the training folds, so a feature's unit doesn't matter.
    """
    names = F.array(*[F.lit(n) for n in design.names])
    long = coefficients.select(
        F.col("target").alias("module"),
        "model",
        F.col("outer_fold").alias("fold"),
        F.explode(F.arrays_zip(names.alias("feature"), F.col("coef").alias("coef"), F.col("coef_std").alias("coef_std"))).alias("e"),
    ).select("module", "model", "fold", "e.feature", "e.coef", "e.coef_std")
    order = W.partitionBy("module", "model", "fold").orderBy(F.desc("abs_coef"), "feature")
    return long.withColumn("abs_coef", F.abs("coef_std")).withColumn("coef_rank", F.row_number().over(order))


def linear_attributions(df: DataFrame, coefficients: DataFrame, design: Design, key: str = "cell_id") -> DataFrame:
    """Held-out exact attributions of a linear model: coef*(x - training mean), with the base value."""
    rows = df.select(key, "fold", *[finite(F.col(c)).alias(f"_x{i}") for i, c in enumerate(design.numeric)])
    joined = _meet(rows, coefficients)
    base = F.col("intercept")
    entries = []
    for i, name in enumerate(design.numeric):
        base = base + F.col("coef")[i] * F.col("x_mean")[i]
        filled = F.coalesce(F.col(f"_x{i}"), F.col("median")[i])
        entries.append(F.struct(F.lit(name).alias("feature"), (F.col("coef")[i] * (filled - F.col("x_mean")[i])).alias("value")))
    return joined.select(
        key, F.col("target").alias("module"), "fold", base.alias("base"), F.explode(F.array(*entries)).alias("e")
    ).select(key, "module", "fold", "base", "e.feature", "e.value")


def _complement(sums: DataFrame, keys: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Turns per-fold sums into sums over all other folds (a window over one row per fold)."""
    over = W.partitionBy(*keys) if keys else W.partitionBy(F.lit(0))
    return sums.select(*keys, "fold", *[(F.sum(c).over(over) - F.col(c)).alias(c) for c in columns])


def mean_baseline(df: DataFrame, by: Sequence[str], y: str = "y_true") -> DataFrame:
    """Adds y_pred: the mean of y over the other folds."""
    by = list(by)
    sums = df.groupBy(*by, "fold").agg(F.sum(y).alias("_s"), F.count(y).alias("_n"))
    means = _complement(sums, by, ["_s", "_n"]).select(*by, "fold", F.try_divide(F.col("_s"), F.col("_n")).alias("y_pred"))
    return df.join(measured(means), [*by, "fold"])


def stratum_baseline(df: DataFrame, by: Sequence[str], stratum: str, y: str = "y_true", alpha: float = 1.0) -> DataFrame:
    """Adds y_pred: ridge on one-hot strata with a free intercept, from counts and sums alone.

    With one-hot predictors the penalised solution is closed form: stratum effect t_h = (s_h - n_h*b)/(n_h + alpha)
    with the intercept b chosen so that residuals sum to zero.
    """
    by = list(by)
    sums = measured(df.groupBy(*by, "fold", stratum).agg(F.sum(y).alias("_s"), F.count(y).alias("_n")))
    whole = sums.groupBy(*by, stratum).agg(F.sum("_s").alias("_ts"), F.sum("_n").alias("_tn"))
    folds = sums.select(*by, "fold").distinct()
    train = (
        folds.join(whole, by)
        .join(sums, [*by, "fold", stratum], "left")
        .select(
            *by,
            "fold",
            stratum,
            (F.col("_ts") - F.coalesce("_s", F.lit(0.0))).alias("_s"),
            (F.col("_tn") - F.coalesce("_n", F.lit(0))).alias("_n"),
        )
        .filter(F.col("_n") > 0)
    )
    shrink = F.col("_n") / (F.col("_n") + alpha)
    one = W.partitionBy(*by, "fold")
    intercept = F.try_divide(
        F.sum("_s").over(one) - F.sum(F.col("_s") * shrink).over(one), F.sum("_n").over(one) - F.sum(F.col("_n") * shrink).over(one)
    )
    fitted = train.withColumn("_b", intercept).select(
        *by, "fold", stratum, (F.col("_b") + (F.col("_s") - F.col("_n") * F.col("_b")) / (F.col("_n") + alpha)).alias("_fit")
    )
    base = train.withColumn("_b", intercept).select(*by, "fold", "_b").distinct()
    joined = df.join(measured(base), [*by, "fold"]).join(measured(fitted), [*by, "fold", stratum], "left")
    return joined.withColumn("y_pred", F.coalesce("_fit", "_b")).drop("_fit", "_b")


def ols_fold_coefficients(df: DataFrame, by: Sequence[str], x: str, y: str) -> DataFrame:
    """(by, fold, slope, intercept) of y on one covariate, fitted on the other folds; sums are taken about the mean."""
    by = list(by)
    usable = finite(F.col(x)).isNotNull() & finite(F.col(y)).isNotNull()
    centre = measured(df.filter(usable).groupBy(*by).agg(F.avg(x).alias("_cx"), F.avg(y).alias("_cy")))
    rows = df.filter(usable).join(centre, by)
    dx, dy = F.col(x) - F.col("_cx"), F.col(y) - F.col("_cy")
    sums = rows.groupBy(*by, "fold").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum(dx).alias("sx"),
        F.sum(dy).alias("sy"),
        F.sum(dx * dx).alias("sxx"),
        F.sum(dx * dy).alias("sxy"),
    )
    n, sx, sy = F.col("n"), F.col("sx"), F.col("sy")
    slope = F.try_divide(F.col("sxy") - F.try_divide(sx * sy, n), F.col("sxx") - F.try_divide(sx * sx, n))
    return (
        _complement(sums, by, ["n", "sx", "sy", "sxx", "sxy"])
        .join(centre, by)
        .withColumn("slope", slope)
        .select(
            *by,
            "fold",
            F.col("n").alias("train_n"),
            "slope",
            (F.col("_cy") + F.try_divide(sy, n) - F.col("slope") * (F.col("_cx") + F.try_divide(sx, n))).alias("intercept"),
        )
    )


def ols_oof(df: DataFrame, by: Sequence[str], x: str, y: str = "y_true") -> DataFrame:
    """Adds y_pred from the one-covariate fit of the other folds."""
    coefficients = ols_fold_coefficients(df, by, x, y).drop("train_n")
    joined = df.join(measured(coefficients), [*by, "fold"])
    return joined.withColumn("y_pred", F.col("intercept") + F.col("slope") * F.col(x)).drop("slope", "intercept")


def residualise(df: DataFrame, by: Sequence[str], y: str, z: tuple[str, str]) -> DataFrame:
    """Adds fitted and residual of y on two nuisance covariates, with coefficients from the other folds.

    Training rows need the same adjustment with the same coefficients; join `residual_coefficients` for that.
    """
    coefficients = residual_coefficients(df, by, y, z)
    a, b = z
    joined = df.join(coefficients, [*by, "fold"])
    fitted = F.col("b0") + F.col("b1") * F.col(a) + F.col("b2") * F.col(b)
    return joined.withColumn("fitted", fitted).withColumn("residual", F.col(y) - F.col("fitted")).drop("b0", "b1", "b2")


def residual_targets(df: DataFrame, by: Sequence[str], y: str, z: tuple[str, str]) -> DataFrame:
    """Adds outer_fold and residual: every row once per outer fold, adjusted with what the other folds alone give.

    Training and test rows of an outer fold are adjusted with the same coefficients, so no training target depends on
    the outcome of a test row.
    """
    by, (a, b) = list(by), z
    coefficients = residual_coefficients(df, by, y, z).withColumnRenamed("fold", "outer_fold")
    joined = df.join(coefficients, by)
    residual = F.col(y) - F.col("b0") - F.col("b1") * F.col(a) - F.col("b2") * F.col(b)
    return joined.withColumn("residual", residual).drop("b0", "b1", "b2")


def residual_performance(
    df: DataFrame, targets: DataFrame, design: Design, candidates: Sequence[tuple[float, float | None]], z: tuple[str, str], key: str = "cell_id",
) -> DataFrame:
    """Pooled out-of-fold R2 and RMSE per target (key, target, y) of models on residuals of two nuisance covariates."""
    rows = targets.join(df.select(key, "fold", *z), key)
    adjusted = residual_targets(rows, ["target"], "y", z)
    named = adjusted.select(key, F.concat_ws("@", "target", F.col("outer_fold").cast("string")).alias("target"), F.col("residual").alias("y"))
    statistics = cut_lineage(fit_statistics(df, named, design, key))
    coefficients = fit_folds(statistics, design, "residual", candidates)
    own, base = F.element_at(F.split("target", "@"), -1).cast("int"), F.regexp_replace("target", "@[^@]*$", "")
    tested = statistics.filter(F.col("fold") == own).withColumn("target", base)
    fitted = coefficients.filter(F.col("outer_fold") == own).withColumn("target", base)
    return gram_performance(tested, fitted, design)


def residual_coefficients(df: DataFrame, by: Sequence[str], y: str, z: tuple[str, str]) -> DataFrame:
    """(by, fold, b0, b1, b2): least squares of y on two covariates over the other folds."""
    by, (a, b) = list(by), z
    centre = measured(df.groupBy(*by).agg(F.avg(a).alias("_ca"), F.avg(b).alias("_cb"), F.avg(y).alias("_cy")))
    rows = df.join(centre, by)
    da, db, dy = F.col(a) - F.col("_ca"), F.col(b) - F.col("_cb"), F.col(y) - F.col("_cy")
    columns = {"n": F.lit(1), "sa": da, "sb": db, "sy": dy, "aa": da * da, "bb": db * db, "ab": da * db, "ay": da * dy, "by": db * dy}
    sums = rows.groupBy(*by, "fold").agg(*[F.sum(c.cast("double")).alias(k) for k, c in columns.items()])
    c = F.col
    train = _complement(sums, by, list(columns)).join(centre, by)
    n = c("n")

    def about_mean(p: str, s: str, t: str) -> Column:
        return c(p) - F.try_divide(c(s) * c(t), n)

    aa, bb, ab = about_mean("aa", "sa", "sa"), about_mean("bb", "sb", "sb"), about_mean("ab", "sa", "sb")
    ay, by_ = about_mean("ay", "sa", "sy"), about_mean("by", "sb", "sy")
    det = aa * bb - ab * ab
    solved = train.withColumns(
        {"b1": F.try_divide(ay * bb - by_ * ab, det), "b2": F.try_divide(by_ * aa - ay * ab, det)}
    )
    b0 = (
        c("_cy")
        + F.try_divide(c("sy"), n)
        - c("b1") * (c("_ca") + F.try_divide(c("sa"), n))
        - c("b2") * (c("_cb") + F.try_divide(c("sb"), n))
    )
    return measured(solved.select(*by, "fold", b0.alias("b0"), "b1", "b2"))


def fold_preprocessing(df: DataFrame, features: Sequence[str], stratum: str, folds: Sequence[int]) -> DataFrame:
    """(outer_fold, feature, median, mean, sd, stratum_mode): training-only statistics after median imputation."""
    long = df.select("fold", *[finite(F.col(c)).alias(c) for c in features]).unpivot(["fold"], list(features), "feature", "x")
    counted = long.groupBy("fold", "feature", "x").agg(F.count(F.lit(1)).alias("w"))
    spread = counted.withColumn("outer_fold", F.explode(F.array(*[F.lit(k) for k in folds]))).filter(
        F.col("fold") != F.col("outer_fold")
    )
    keys = ["outer_fold", "feature"]
    medians = exact_quantiles(spread, keys, "x", {"median": 0.5}, weight="w").drop("n")
    filled = spread.join(medians, keys).withColumn("v", F.coalesce("x", "median") - F.col("median"))
    n = F.sum("w")
    mean = F.sum(F.col("v") * F.col("w")) / n
    stats = filled.groupBy(*keys, "median").agg(
        n.alias("train_n"),
        (F.col("median") + mean).alias("mean"),
        F.sqrt(F.greatest(F.sum(F.col("v") * F.col("v") * F.col("w")) / n - mean * mean, F.lit(0.0))).alias("sd"),
    )
    levels = df.groupBy("fold", stratum).agg(F.count(F.lit(1)).alias("w"))
    mode = (
        levels.withColumn("outer_fold", F.explode(F.array(*[F.lit(k) for k in folds])))
        .filter((F.col("fold") != F.col("outer_fold")) & F.col(stratum).isNotNull())
        .groupBy("outer_fold", stratum)
        .agg(F.sum("w").alias("w"))
        .groupBy("outer_fold")
        .agg(F.min(F.struct((-F.col("w")).alias("w"), F.col(stratum).alias("s"))).getField("s").alias("stratum_mode"))
    )
    return stats.join(mode, "outer_fold")
