"""Boosted-tree out-of-fold predictions with pyspark.ml."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.operators.folds import inner_group_split
from cohortlens.operators.gram import Design, training_medians, with_mask
from cohortlens.session import cut_lineage

# Fixed values of the analyses: trees, depth, learning rate (pyspark.ml has no L2 leaf penalty).
CANDIDATES = (
    {"maxIter": 250, "maxDepth": 2, "stepSize": 0.05},
    {"maxIter": 400, "maxDepth": 2, "stepSize": 0.03},
    {"maxIter": 250, "maxDepth": 3, "stepSize": 0.05},
    {"maxIter": 300, "maxDepth": 4, "stepSize": 0.03},
)


def _impute(rows: DataFrame, features: Sequence[str], medians: DataFrame, fold: int, scope: str) -> DataFrame:
    wide = (
        medians.filter((F.col("outer_fold") == fold) & (F.col("scope") == scope))
        .agg(F.map_from_entries(F.collect_list(F.struct("feature", "median"))))
        .scalar()
    )
    filled = rows.withColumn("_med", wide)
    return filled.withColumns(
        {c: F.coalesce(F.col(c).cast("double"), F.element_at("_med", F.lit(c)), F.lit(0.0)) for c in features}
    ).drop("_med")


def boosted_oof(
    df: DataFrame,
    features: Sequence[str],
    target: str,
    folds: Sequence[int],
    module: str,
    candidates: Sequence[dict] = CANDIDATES,
    seed: int = 42,
) -> tuple[DataFrame, list[dict]]:
    """Predictions of each fold by trees fitted on the other folds; the inner group split picks the candidate.

    Tree fitting is distributed by pyspark.ml; the loops run over folds and candidates, never over rows.
    """
    assembler = VectorAssembler(inputCols=list(features), outputCol="features_vec")
    design = Design(tuple(features), tuple(features), folds=tuple(folds), seed=seed)
    masked = with_mask(df, design)
    medians = cut_lineage(training_medians(masked, design))
    split = inner_group_split(df, "group_id", folds, seed=seed)
    parts, chosen = [], []

    def fit(rows: DataFrame, parameters: dict):
        model = GBTRegressor(
            featuresCol="features_vec", labelCol=target, predictionCol="y_pred", subsamplingRate=0.8,
            featureSubsetStrategy="0.8", seed=seed, **parameters,
        )
        return model.fit(rows)

    for fold in folds:
        train, test = df.filter(F.col("fold") != fold), df.filter(F.col("fold") == fold)
        best, score = candidates[0], None
        if len(candidates) > 1:
            inner = split.filter(F.col("outer_fold") == fold).select("group_id", "is_validation")
            filled = _impute(train.join(inner, "group_id"), features, medians, fold, "inner")
            sided = assembler.transform(cut_lineage(filled.select("is_validation", target, *features)))
            fit_rows, check_rows = sided.filter(~F.col("is_validation")), sided.filter("is_validation")
            for parameters in candidates:
                predicted = fit(fit_rows, parameters).transform(check_rows)
                error = predicted.agg(F.sqrt(F.avg(F.pow(F.col(target) - F.col("y_pred"), 2)))).first()[0]
                if score is None or error < score:
                    best, score = parameters, error
        filled = cut_lineage(_impute(train, features, medians, fold, "full").select(target, *features))
        fitted = fit(assembler.transform(filled), best)
        scored = fitted.transform(assembler.transform(_impute(test, features, medians, fold, "full")))
        parts.append(
            scored.select(
                "cell_id", "group_id", "stratum", "fold", F.lit(module).alias("module"), F.lit("boosted").alias("model"),
                F.col(target).alias("y_true"), "y_pred",
            )
        )
        chosen.append({"module": module, "fold": fold, "inner_rmse": score, **best})
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out, chosen
