"""Cluster bootstrap and permutation tests from saved predictions; nothing is refitted.

Row data is reduced once to sufficient statistics per (key, group). A draw plan holds which
group each of the G slots of a replicate picks; it is built by exploding the indexed groups,
so it needs no driver loop and is the same for every key and contrast.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cohortlens.functions.numeric import billionths, plus_one_p, sign_tail_p
from cohortlens.functions.rng import hash32, hash32_numbers, pick
from cohortlens.operators.metrics import METRICS, bootstrap_intervals, oriented_delta, paired_finite
from cohortlens.operators.permute import permuted_products
from cohortlens.operators.rankcorr import _packed, _unpacked, spearman, spearman_lanes
from cohortlens.operators.ranks import ordered_index, value_ranks
from cohortlens.session import bucket_count, cut_lineage, measured  # noqa: F401  (a test takes cut_lineage from here)

#: Slots of a range of groups, draws hashed at a time, groups counted at a time, and replicates multiplied at a time.
GROUP_BLOCK, DRAW_BLOCK, SEGMENT, REPLICATE_BLOCK = 1 << 14, 1 << 22, 1 << 24, 256
#: Bytes of the weights of a range of groups under all replicates.
LANE_BYTES = 1 << 22


def index_groups(df: DataFrame, group: str, seed: int) -> DataFrame:
    """Distinct groups with a dense hash-ordered index and their number."""
    distinct = df.select(F.col(group).cast("string").alias(group)).distinct()
    return ordered_index(distinct, [], hash32(seed, F.col(group)), [group], "slot", "n_groups", hashed=True)


def _number(groups: DataFrame) -> int:
    return groups.agg(F.max("n_groups")).first()[0] or 0


def draw_plan(groups: DataFrame, n_resamples: int, seed: int) -> DataFrame:
    """(replicate, slot) rows: the slot picked by each of the G draws of a replicate."""
    spread = groups.select(
        "slot", "n_groups", F.explode(F.sequence(F.lit(0), F.lit(n_resamples - 1))).alias("replicate")
    )
    return spread.select("replicate", pick(F.col("n_groups"), seed, F.col("replicate"), F.col("slot")).alias("slot"))


def _group_stats(df: DataFrame, by: Sequence[str], group: str, y: str, preds: Sequence[str]) -> DataFrame:
    centre = measured(df.groupBy(*by).agg(F.avg(y).alias("_c")))
    t = F.col(y) - F.col("_c")
    aggs: list[Column] = [F.count(y).alias("n"), F.sum(t).alias("sy"), F.sum(t * t).alias("syy")]
    for p in preds:
        e = F.col(y) - F.col(p)
        aggs += [F.sum(F.abs(e)).alias(f"abs_{p}"), F.sum(e * e).alias(f"sq_{p}")]
    return df.join(centre, list(by)).groupBy(*by, group).agg(*aggs)


def draw_weights(spark: SparkSession, n_groups: int, n_resamples: int, seed: int, width: int) -> DataFrame:
    """(_q, replicate, w): how often a replicate picks each group, packed by ranges of `width` slots.

    The same draws as those of draw_plan. A range of a replicate has several rows if its draws are hashed in several parts;
    they add up. What moves is about a byte for each group and replicate.
    """
    parts, segment = -(-n_groups // DRAW_BLOCK), width * max(1, SEGMENT // width)

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        made, held = [], 0
        for i in (i for batch in batches for i in batch["id"].tolist()):
            replicate, low = i // parts, i % parts * DRAW_BLOCK
            picks = hash32_numbers(f"{seed}|{replicate}", low, min(low + DRAW_BLOCK, n_groups)) % np.uint64(n_groups)
            for start in range(0, n_groups, segment):
                end = min(start + segment, n_groups)
                own = picks if end - start == n_groups else picks[(picks >= start) & (picks < end)] - np.uint64(start)
                times = np.bincount(own.astype(np.int64), minlength=end - start)
                made += [((start + j) // width, replicate, _packed(times[j : j + width])) for j in range(0, end - start, width)]
                held += end - start
                if held >= SEGMENT:
                    yield pd.DataFrame(made, columns=["_q", "replicate", "w"])
                    made, held = [], 0
        yield pd.DataFrame(made, columns=["_q", "replicate", "w"])

    todo = n_resamples * parts
    return spark.range(0, todo, 1, max(1, min(todo, bucket_count(spark.range(0))))).mapInPandas(draw, "_q long, replicate int, w binary")


def _replicate_errors(df: DataFrame, by, group, y, preds, groups: DataFrame, n_groups: int, n_resamples: int, seed: int) -> DataFrame:
    """Weighted R2, MAE and RMSE per (by, replicate) for each prediction column.

    Sums of the groups are a matrix for each range of slots, weights another; a replicate's sums are their product.
    """
    by = list(by)
    sums = ["n", "sy", "syy"] + [f"{k}_{p}" for p in preds for k in ("abs", "sq")]
    stats = measured(_group_stats(df, by, group, y, preds).join(groups.select(group, "slot"), group).drop(group))
    keys = measured(stats.select(*by).distinct().withColumn("_k", F.monotonically_increasing_id()))
    width = max(64, min(GROUP_BLOCK, 8 * GROUP_BLOCK // max(1, keys.count())))
    values = [F.coalesce(F.col(c).cast("double"), F.lit(0.0)).alias(c) for c in sums]
    placed = stats.join(keys, by).select("_k", F.floor(F.col("slot") / width).alias("_q"), (F.col("slot") % width).alias("_at"), F.lit(1.0).alias("_met"), *values)
    columns = ["_met", *sums]
    schema = "_k long, replicate int, " + ", ".join(f"`{c}` double" for c in columns)

    def multiply(own: pd.DataFrame, drawn: pd.DataFrame) -> pd.DataFrame:
        out = [pd.DataFrame({c: [] for c in ["_k", "replicate", *columns]})]
        if len(own) and len(drawn):
            n = min(width, n_groups - int(drawn["_q"].iloc[0]) * width)
            held = [(k, x["_at"].to_numpy(), x[columns].to_numpy()) for k, x in own.groupby("_k")]
            for low in range(0, len(drawn), REPLICATE_BLOCK):
                part = drawn.iloc[low : low + REPLICATE_BLOCK]
                w = np.stack([_unpacked(x, n, 1)[:, 0] for x in part["w"]]).astype(float)
                for k, at, x in held:
                    usable = np.isfinite(x)
                    made = w[:, at] @ np.where(usable, x, 0.0)
                    for j in np.flatnonzero(~usable.all(axis=1)).tolist():  # a group that is not drawn spoils nothing
                        made[w[:, at[j]] > 0] += np.where(usable[j], 0.0, x[j])
                    out.append(pd.DataFrame({"_k": k, "replicate": part["replicate"].to_numpy()} | dict(zip(columns, made.T, strict=True))))
        return pd.concat(out, ignore_index=True) if len(out) < 2 else pd.concat(out[1:], ignore_index=True)

    weights = draw_weights(df.sparkSession, n_groups, n_resamples, seed, width)
    products = placed.groupBy("_q").cogroup(weights.groupBy("_q")).applyInPandas(multiply, schema)
    drawn = products.groupBy("_k", "replicate").agg(*[F.sum(c).alias(c) for c in columns]).filter(F.col("_met") > 0).join(keys, "_k")
    n = F.col("n").cast("bigint")
    sst = F.col("syy") - F.try_divide(F.col("sy") * F.col("sy"), n)
    out = []
    for p in preds:
        out += [
            F.when(sst > 0, 1 - F.try_divide(F.col(f"sq_{p}"), sst)).alias(f"r2_{p}"),
            F.try_divide(F.col(f"abs_{p}"), n).alias(f"mae_{p}"),
            F.sqrt(F.try_divide(F.col(f"sq_{p}"), n)).alias(f"rmse_{p}"),
        ]
    return drawn.select(*by, "replicate", n.alias("n_sampled_rows"), *out)


def _replicate_spearman(df: DataFrame, by, group, y, preds, groups: DataFrame, n_groups: int, n_resamples: int, seed: int, batch: int) -> DataFrame:
    """Spearman per (by, replicate) from weighted mid-ranks.

    Replicates travel in batches: a row carries the multiplicity of its group in each replicate of a batch, a byte each,
    so rows are sorted and joined once per batch rather than once per replicate.
    """
    by, batches = list(by), -(-n_resamples // batch)
    width = max(64, min(GROUP_BLOCK, LANE_BYTES // n_resamples))
    weights = draw_weights(df.sparkSession, n_groups, n_resamples, seed, width)

    def turn(pdf: pd.DataFrame) -> pd.DataFrame:
        """The weights of a range of slots, by slot."""
        low = int(pdf["_q"].iloc[0]) * width
        n = min(width, n_groups - low)
        times = np.zeros((batches * batch, n), np.uint8)
        for replicate, w in zip(pdf["replicate"], pdf["w"], strict=True):
            total = times[replicate] + _unpacked(w, n, 1)[:, 0]
            if total.max() > 255:
                raise ValueError("a replicate picks one group more than 255 times")
            times[replicate] = total
        return pd.DataFrame({"slot": np.arange(low, low + n), "w": [x.tobytes() for x in np.ascontiguousarray(times.T)]})

    drawn = measured(weights.groupBy("_q").applyInPandas(turn, "slot long, w binary").join(groups, "slot").select(group, "w"))
    keys, out = measured(df.select(*by).distinct()), None
    for p in preds:
        rows = df.select(*by, group, y, p).repartition(group).join(drawn, group)  # work follows rows times replicates, not files
        rho = spearman_lanes(rows, by, y, p, keys=keys, packed=("w", batch, batches)).filter(F.col("n") > 0)
        rho = rho.select(*by, F.col("lane").alias("replicate"), F.col("rho").alias(f"spearman_{p}"))
        out = rho if out is None else out.join(rho, [*by, "replicate"])
    return out


def cluster_bootstrap(
    df: DataFrame,
    by: Sequence[str],
    group: str = "group_id",
    y: str = "y_true",
    p: str = "y_pred",
    n_resamples: int = 1000,
    seed: int = 42,
    spearman: bool = True,
    batch: int = 50,
) -> DataFrame:
    """One row per key and replicate with the metrics of the resampled groups."""
    clean = paired_finite(df.withColumn(group, F.col(group).cast("string")), y, p).filter(F.col(y).isNotNull())
    groups = measured(index_groups(clean, group, seed))
    n_groups = _number(groups)
    errors = _replicate_errors(clean, by, group, y, [p], groups, n_groups, n_resamples, seed)
    if spearman:
        rho = _replicate_spearman(clean, by, group, y, [p], groups, n_groups, n_resamples, seed, min(batch, n_resamples))
        errors = errors.join(rho, [*by, "replicate"])
    names = [m for m in METRICS if spearman or m != "spearman"]
    return errors.select(*by, "replicate", "n_sampled_rows", *[F.col(f"{m}_{p}").alias(m) for m in names])


def paired_view(
    oof: DataFrame, model_a: str, model_b: str, keys: Sequence[str] = ("module", "cell_id")
) -> tuple[DataFrame, DataFrame]:
    """Two models of the same cells side by side, and the identity violations between them."""
    identity = ["group_id", "stratum", "fold", "y_true"]
    keys = list(keys)

    def side(model: str, suffix: str) -> DataFrame:
        rows = oof.filter(F.col("model") == model)
        return rows.select(
            *keys, *[F.col(c).alias(f"{c}_{suffix}") for c in identity], F.col("y_pred").alias(f"y_pred_{suffix}")
        )

    joined = side(model_a, "a").join(side(model_b, "b"), keys, "full_outer")
    differs = [(~F.col(f"{c}_a").eqNullSafe(F.col(f"{c}_b")), c) for c in identity]
    reason = F.concat_ws(";", *[F.when(cond, F.lit(name)) for cond, name in differs])
    violations = joined.withColumn("differs", reason).filter(reason != "").select(*keys, "differs")
    view = joined.filter(reason == "").select(
        *keys, *[F.col(f"{c}_a").alias(c) for c in identity], "y_pred_a", "y_pred_b"
    )
    return view, violations


def paired_bootstrap(
    pairs: DataFrame, by: Sequence[str], group: str = "group_id", n_resamples: int = 1000, seed: int = 42,
    spearman: bool = True, batch: int = 50,
) -> DataFrame:
    """Long draws (by, metric, replicate, metric_a, metric_b, delta) under one shared plan."""
    by = list(by)
    preds = ["y_pred_a", "y_pred_b"]
    rows = pairs.withColumn(group, F.col(group).cast("string"))
    groups = measured(index_groups(rows, group, seed))
    n_groups = _number(groups)
    wide = _replicate_errors(rows, by, group, "y_true", preds, groups, n_groups, n_resamples, seed)
    names = [m for m in METRICS if spearman or m != "spearman"]
    if spearman:
        rho = _replicate_spearman(rows, by, group, "y_true", preds, groups, n_groups, n_resamples, seed, min(batch, n_resamples))
        wide = wide.join(rho, [*by, "replicate"])
    entries = F.array(
        *[
            F.struct(F.lit(m).alias("metric"), F.col(f"{m}_y_pred_a").alias("metric_a"), F.col(f"{m}_y_pred_b").alias("metric_b"))
            for m in names
        ]
    )
    long = wide.select(*by, "replicate", F.explode(entries).alias("e")).select(*by, "replicate", "e.*")
    return long.withColumn("delta", oriented_delta(F.col("metric"), F.col("metric_a"), F.col("metric_b")))


def paired_summary(draws: DataFrame, by: Sequence[str]) -> DataFrame:
    """Interval, sign counts and sign-tail p of the paired deltas."""
    keys = [*by, "metric"]
    d = F.col("delta")
    signs = draws.groupBy(*keys).agg(
        F.count(d).alias("n_bootstrap"),
        F.count_if(d > 0).alias("count_gt0"),
        F.count_if(d < 0).alias("count_lt0"),
        F.count_if(d == 0).alias("count_eq0"),
    )
    n = F.col("n_bootstrap")
    return (
        signs.join(bootstrap_intervals(draws, keys, "delta").drop("n_draws"), keys)
        .withColumn("prob_gt0", F.try_divide(F.col("count_gt0").cast("double"), n))
        .withColumn("prob_lt0", F.try_divide(F.col("count_lt0").cast("double"), n))
        .withColumn("p_sign_tail", sign_tail_p(F.col("count_gt0"), F.col("count_lt0"), n))
    )


def _centred_ranks(df: DataFrame, by: Sequence[str], y: str, p: str) -> DataFrame:
    ranked = value_ranks(df, by, {y: "_ry", p: "_rp"})
    n = measured(df.groupBy(*by).agg(F.count(F.lit(1)).alias("_n")))
    mid = (F.col("_n") + 1) / 2.0
    return ranked.join(n, list(by)).withColumns({"_ry": F.col("_ry") - mid, "_rp": F.col("_rp") - mid}).drop("_n")


def stratified_permutation(
    df: DataFrame,
    by: Sequence[str],
    stratum: str,
    cell: str,
    n_permutations: int,
    seed: int,
    y: str = "y_true",
    p: str = "y_pred",
) -> DataFrame:
    """Null Spearman per (by, iteration): truth ranks are permuted inside each stratum.

    Ranks are computed once. A cell takes the prediction rank found at its hash-ordered position; see `permute`. Doubled
    ranks about their mean are whole numbers.
    """
    by = list(by)
    ranked = measured(_centred_ranks(df.select(*by, stratum, cell, y, p), by, y, p))
    scale = ranked.groupBy(*by).agg(
        F.sqrt(F.sum(F.col("_ry") * F.col("_ry")) * F.sum(F.col("_rp") * F.col("_rp"))).alias("_norm")
    )
    products = permuted_products(ranked, by, stratum, cell, 2 * F.col("_ry"), 2 * F.col("_rp"), n_permutations, seed)
    return products.join(scale, by).select(*by, "iteration", F.try_divide(F.col("dot") / 4, F.col("_norm")).alias("rho"))


def observed_spearman(df: DataFrame, by: Sequence[str], y: str = "y_true", p: str = "y_pred") -> DataFrame:
    return spearman(df, by, y, p).select(*by, F.col("rho").alias("observed_spearman"))


def permutation_summary(null: DataFrame, observed: DataFrame, by: Sequence[str]) -> DataFrame:
    """Two-sided plus-one p and the mean and SD of the null."""
    by = list(by)
    joined = null.join(observed, by, "left")
    extreme = F.count_if(F.abs("rho") >= F.abs("observed_spearman"))
    return (
        joined.groupBy(*by)
        .agg(
            F.max("observed_spearman").alias("observed_spearman"),
            F.count("rho").alias("n_permutations"),
            extreme.alias("extreme_count"),
            F.avg("rho").alias("null_mean"),
            F.stddev_samp("rho").alias("null_sd"),
        )
        .withColumn("p_two_sided", plus_one_p(F.col("extreme_count"), F.col("n_permutations")))
    )


def permutation_moments(df: DataFrame, by: Sequence[str], stratum: str, y: str = "y_true", p: str = "y_pred") -> DataFrame:
    """Exact mean and SD of the stratified permutation null, without drawing from it.

    Everything follows from counts, means and sums of squares of the ranks per stratum.
    """
    by = list(by)
    ranked = value_ranks(df.select(*by, stratum, y, p), by, {y: "_ry", p: "_rp"})
    per = ranked.groupBy(*by, stratum).agg(
        F.count(F.lit(1)).alias("n"),
        F.avg("_ry").alias("my"),
        F.avg("_rp").alias("mp"),
        (F.var_pop("_ry") * F.count("_ry")).alias("ssy"),
        (F.var_pop("_rp") * F.count("_rp")).alias("ssp"),
    )
    whole = per.groupBy(*by).agg(((F.sum("n") + 1) / 2.0).alias("_mid"))
    dy, dp, n = F.col("my") - F.col("_mid"), F.col("mp") - F.col("_mid"), F.col("n")
    spread = F.coalesce(F.try_divide(F.col("ssy") * F.col("ssp"), n - 1), F.lit(0.0))
    total = per.join(whole, by).groupBy(*by).agg(
        F.sum(n * dy * dp).alias("_mean"),
        F.sum(spread).alias("_var"),
        F.sqrt(F.sum(F.col("ssy") + n * dy * dy) * F.sum(F.col("ssp") + n * dp * dp)).alias("_norm"),
    )
    return total.select(
        *by,
        F.try_divide(F.col("_mean"), F.col("_norm")).alias("null_mean"),
        F.try_divide(F.sqrt("_var"), F.col("_norm")).alias("null_sd"),
    )


def centre_by_stratum(df: DataFrame, by: Sequence[str], stratum: str, cols: Sequence[str]) -> DataFrame:
    """Adds <col>_residual = value minus its (by, stratum) mean; means are joined, not windowed."""
    keys = [*by, stratum]
    means = measured(df.groupBy(*keys).agg(*[F.avg(c).alias(f"_mean_{c}") for c in cols]))
    return df.join(means, keys).withColumns(
        {f"{c}_residual": F.col(c) - F.col(f"_mean_{c}") for c in cols}
    ).drop(*[f"_mean_{c}" for c in cols])


def group_level_means(df: DataFrame, by: Sequence[str], group: str, stratum: str) -> DataFrame:
    """Stratum-centred truth and prediction averaged once per group.

    Residuals are summed in whole billionths: groups with equal rows then tie, in whatever order rows are added.
    """
    centred = centre_by_stratum(df, by, stratum, ["y_true", "y_pred"])

    def mean(c: str) -> Column:
        return F.try_divide(F.sum(billionths(F.col(c))), F.count(c) * F.lit(1e9))

    means = centred.groupBy(*by, group).agg(
        mean("y_true_residual").alias("y_true"),
        mean("y_pred_residual").alias("y_pred"),
        F.count("y_true").alias("n_cells"),
    )
    return measured(means)


def group_permutation(df: DataFrame, by: Sequence[str], group: str, stratum: str, n_permutations: int, seed: int) -> DataFrame:
    """Null Spearman at group level after removing stratum means; the group is the unit permuted."""
    units = group_level_means(df, by, group, stratum).withColumn("_all", F.lit("all"))
    return stratified_permutation(units, by, "_all", group, n_permutations, seed)
