"""Stand-in views: the roles of the analyses played by the given tables. Each takes (spark, sf_dir)."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens import session
from cohortlens.functions.numeric import safe_corr
from cohortlens.operators.folds import hash_folds
from cohortlens.operators.gram import Design, mean_baseline, ols_oof, stratum_baseline
from cohortlens.sources.tables import table

MODULES = ("Brand#1", "Brand#2", "Brand#3", "Brand#4", "Brand#5", "Brand#6")
STRATA = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
TARGETS = ("line_value", "list_price", "order_total")
FEATURES = ("f1", "f2", "f3", "f4", "f5", "f6")
FOLDS = (0, 1, 2)
MODELS = ("mean", "ols", "stratum")


_STAGED: dict[tuple[str, str, str], str] = {}


def staged(spark: SparkSession, sf_dir: str, name: str, build: Callable[[], DataFrame]) -> DataFrame:
    """A table a stage hands to the next: written once per application to the shared folder, then only read.

    Later operators read such a table several times (ranks, group statistics); the written copy also
    cuts the lineage, so a lost executor never replays the models behind the predictions.
    """
    key = (spark.sparkContext.applicationId, sf_dir, name)
    if key in _STAGED:
        try:
            return spark.read.parquet(_STAGED[key])
        except AnalysisException:
            del _STAGED[key]
    path = scratch(spark)
    build().write.parquet(path)
    _STAGED[key] = path
    return spark.read.parquet(path)


def text(name: str):
    return F.col(name).cast("string")


def counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(sample_id, gene, cnt): supplier by brand and size, quantities summed."""
    lines = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_partkey", "l_quantity")
    parts = table(spark, sf_dir, "part").select("p_partkey", F.concat_ws("|", "p_brand", text("p_size")).alias("gene"))
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy(text("l_suppkey").alias("sample_id"), "gene")
        .agg(F.sum("l_quantity").cast("bigint").alias("cnt"))
    )


def library(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = table(spark, sf_dir, "lineitem")
    return lines.groupBy(text("l_suppkey").alias("sample_id")).agg(F.sum("l_quantity").cast("bigint").alias("lib"))


def requested(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, gene, ordinal): eight sizes of six brands, whether or not a part has them."""
    brands = table(spark, sf_dir, "part").filter(F.col("p_brand").isin(*MODULES)).select(F.col("p_brand").alias("module"))
    return brands.distinct().withColumn("ordinal", F.explode(F.sequence(F.lit(1), F.lit(8)))).select(
        "module", F.concat_ws("|", "module", text("ordinal")).alias("gene"), "ordinal"
    )


def every_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, gene, ordinal): every brand of part with every size up to the largest, whether or not a part has them."""
    parts = table(spark, sf_dir, "part")
    largest = parts.agg(F.max("p_size").cast("int")).scalar()
    brands = parts.filter(F.col("p_brand").isNotNull()).select(F.col("p_brand").alias("module")).distinct()
    return brands.withColumn("ordinal", F.explode(F.sequence(F.lit(1), largest))).select("module", F.concat_ws("|", "module", text("ordinal")).alias("gene"), "ordinal")


def order_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per order, exact whole-number sums: money in cents, rates in hundredths."""

    def hundredths(c: str):
        return F.sum(F.round(F.col(c) * 100).cast("bigint"))

    lines = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_partkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"
    )
    parts = table(spark, sf_dir, "part").select("p_partkey", "p_retailprice")
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("l_orderkey")
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.sum("l_quantity").cast("bigint").alias("qty"),
            hundredths("l_extendedprice").alias("cents"),
            hundredths("l_discount").alias("disc"),
            hundredths("l_tax").alias("tax"),
            hundredths("p_retailprice").alias("list"),
            F.max("l_quantity").alias("maxq"),
            F.min("l_quantity").alias("minq"),
        )
    )


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    return staged(spark, sf_dir, "cells", lambda: build_cells(spark, sf_dir))


def build_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with their lines: key, group, stratum, fold, six features (f6 may be missing), f7 = f1, targets."""
    orders = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderpriority", "o_orderstatus", "o_totalprice")
    joined = orders.join(order_lines(spark, sf_dir), F.col("o_orderkey") == F.col("l_orderkey"))
    d = F.col("n").cast("double")
    rows = joined.select(
        text("o_orderkey").alias("cell_id"),
        text("o_custkey").alias("group_id"),
        F.col("o_orderpriority").alias("stratum"),
        F.col("o_orderstatus").alias("status"),
        F.col("qty").cast("double").alias("f1"),
        (F.col("disc") / d).alias("f2"),
        (F.col("tax") / d).alias("f3"),
        d.alias("f4"),
        F.col("maxq").alias("f5"),
        F.when(F.col("n") > 1, F.col("maxq") - F.col("minq")).alias("f6"),
        F.col("qty").cast("double").alias("f7"),
        F.log(F.col("cents") / F.lit(100.0)).alias("line_value"),
        (F.col("list") / d / F.lit(100.0)).alias("list_price"),
        F.log("o_totalprice").alias("order_total"),
    )
    return hash_folds(rows, "group_id", 3)


def long_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, group_id, stratum, status, fold, f1, f4, module, y_true)."""
    return cells(spark, sf_dir).select(
        "cell_id", "group_id", "stratum", "status", "fold", "f1", "f4", *TARGETS
    ).unpivot(["cell_id", "group_id", "stratum", "status", "fold", "f1", "f4"], list(TARGETS), "module", "y_true")


def build_oof(spark: SparkSession, sf_dir: str, model: str) -> DataFrame:
    """Out-of-fold predictions of a simple model: fold-complement mean, one-covariate OLS or stratum ridge."""
    y = long_targets(spark, sf_dir)
    keep = ["cell_id", "group_id", "stratum", "status", "fold", "module", "model", "analysis", "y_true", "y_pred"]
    analysis, make = {
        "mean": ("dummy", lambda: mean_baseline(y, ["module"])),
        "ols": ("features_only", lambda: ols_oof(y, ["module"], "f1")),
        "stratum": ("stratum_only", lambda: stratum_baseline(y, ["module"], "stratum")),
    }[model]
    return make().withColumns({"model": F.lit(model), "analysis": F.lit(analysis)}).select(*keep)


def oof(spark: SparkSession, sf_dir: str, models: tuple[str, ...] = MODELS) -> DataFrame:
    """The predictions of the given models; each model is made and written when it is first asked for."""
    out = None
    for model in models:
        part = staged(spark, sf_dir, f"oof_{model}", lambda: build_oof(spark, sf_dir, model))
        out = part if out is None else out.unionByName(part)
    return out


def pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ols against mean on the same cells."""
    from cohortlens.operators.resample import paired_view

    return staged(spark, sf_dir, "pairs", lambda: paired_view(oof(spark, sf_dir, ("mean", "ols")), "ols", "mean")[0])


def control_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, control_id, r2): squared correlation of quantity and price per return flag and supplier."""
    lines = table(spark, sf_dir, "lineitem")
    rho = safe_corr(F.col("l_quantity"), F.col("l_extendedprice"))
    return (
        lines.groupBy(F.col("l_returnflag").alias("module"), F.col("l_suppkey").alias("control_id"))
        .agg(rho.alias("_rho"))
        .select("module", "control_id", (F.col("_rho") * F.col("_rho")).alias("r2"))
    )


def observed_performance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(module, observed): the same measure on all lines, all suppliers together."""
    lines = table(spark, sf_dir, "lineitem")
    rho = safe_corr(F.col("l_quantity"), F.col("l_extendedprice"))
    return lines.groupBy(F.col("l_returnflag").alias("module")).agg(rho.alias("_rho")).select(
        "module", (F.col("_rho") * F.col("_rho")).alias("observed")
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(vec_id, label, i, x): embeddings by component."""
    return table(spark, sf_dir, "embeddings").select("vec_id", "label", F.posexplode("embedding").alias("i", "_x")).select(
        "vec_id", "label", "i", F.col("_x").cast("double").alias("x")
    )


def design(nullable: bool = True, stratum: bool = False, features: tuple[str, ...] = FEATURES) -> Design:
    return Design(
        numeric=features,
        nullable=("f6",) if nullable and "f6" in features else (),
        stratum="stratum" if stratum else None,
        levels=STRATA if stratum else (),
        folds=FOLDS,
    )


def y_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(cell_id, target, y)."""
    return cells(spark, sf_dir).select("cell_id", *TARGETS).unpivot(["cell_id"], list(TARGETS), "target", "y")


def curves(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(run, step, loss): the events of a user in order stand in for the epochs of a run."""
    from cohortlens.operators.ranks import ordered_index

    events = table(spark, sf_dir, "events").select(F.col("user_id").alias("run"), "event_id", F.col("value").alias("loss"))
    placed = ordered_index(events, ["run"], F.col("event_id"), ["event_id"], "_pos")
    return placed.select("run", (F.col("_pos") + 1).alias("step"), "loss")


def scratch(spark: SparkSession) -> str:
    """A new folder next to the checkpoints, which every executor can reach."""
    session._checkpoint_dir(spark)
    return f"{spark.sparkContext.getCheckpointDir()}/scratch-{uuid.uuid4().hex}"


def samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Suppliers as cells: grouped by nation, stratified by region, four features and the library size."""

    def hundredths(c: str):
        return F.sum(F.round(F.col(c) * 100).cast("bigint"))

    lines = table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(
        F.count(F.lit(1)).alias("n"), hundredths("l_discount").alias("disc"), hundredths("l_tax").alias("tax")
    )
    places = table(spark, sf_dir, "nation").join(
        table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    rows = (
        table(spark, sf_dir, "supplier")
        .join(lines, F.col("s_suppkey") == F.col("l_suppkey"))
        .join(places, F.col("s_nationkey") == F.col("n_nationkey"))
        .select(
            text("s_suppkey").alias("cell_id"),
            F.col("n_name").alias("group_id"),
            F.col("r_name").alias("stratum"),
            F.col("s_acctbal").alias("f1"),
            (F.col("disc") / F.col("n")).alias("f2"),
            (F.col("tax") / F.col("n")).alias("f3"),
            F.col("n").cast("double").alias("f4"),
        )
    )
    return hash_folds(rows, "group_id", 3)


def sample_design() -> Design:
    return Design(numeric=("f1", "f2", "f3", "f4"), folds=FOLDS)
