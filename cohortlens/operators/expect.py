"""Checks that return violation tables instead of failing in the middle of a plan."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from itertools import product

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numeric import finite, is_close


def duplicate_keys(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once."""
    return df.groupBy(*keys).agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > 1)


def checked_join(
    left: DataFrame, right: DataFrame, on: Sequence[str], how: str = "left", validate: str = "many_to_one"
) -> tuple[DataFrame, DataFrame]:
    """The join, and the keys that break its declared cardinality (side, keys, n)."""
    on = list(on)
    checks = []
    if validate in ("one_to_one", "one_to_many"):
        checks.append(duplicate_keys(left.select(*on), on).withColumn("side", F.lit("left")))
    if validate in ("one_to_one", "many_to_one"):
        checks.append(duplicate_keys(right.select(*on), on).withColumn("side", F.lit("right")))
    violations = checks[0]
    for extra in checks[1:]:
        violations = violations.unionByName(extra)
    return left.join(right, on, how), violations


def outer_with_source(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """Full outer join with a column saying which side a key came from."""
    a = left.withColumn("_l", F.lit(True))
    b = right.withColumn("_r", F.lit(True))
    joined = a.join(b, list(on), "full_outer")
    source = (
        F.when(F.col("_l").isNotNull() & F.col("_r").isNotNull(), "both")
        .when(F.col("_l").isNotNull(), "left_only")
        .otherwise("right_only")
    )
    return joined.withColumn("source", source).drop("_l", "_r")


def left_with_match(left: DataFrame, right: DataFrame, on: Sequence[str], flag: str = "matched") -> DataFrame:
    joined = left.join(right.withColumn("_r", F.lit(True)), list(on), "left")
    return joined.withColumn(flag, F.coalesce("_r", F.lit(False))).drop("_r")


def rejected_rows(df: DataFrame, known: DataFrame, on: Sequence[str], reason: str) -> DataFrame:
    """Rows whose key is unknown, with the reason."""
    return df.join(known.select(*on).distinct(), list(on), "left_anti").withColumn("reason", F.lit(reason))


def with_lookup(df: DataFrame, lookup: DataFrame, on: Sequence[str], value: str) -> tuple[DataFrame, DataFrame]:
    """Left lookup plus a one-row completeness report."""
    joined = df.join(lookup.select(*on, value), list(on), "left")
    report = joined.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count_if(finite(F.col(value)).isNull()).alias("n_missing")
    )
    return joined, report


def expected_grid(df: DataFrame, keys: Sequence[str], levels: Mapping[str, Sequence]) -> DataFrame:
    """Distinct keys of df repeated for each combination of the given short level lists."""
    grid = df.select(*keys).distinct()
    for name, values in levels.items():
        grid = grid.withColumn(name, F.explode(F.array(*[F.lit(v) for v in values])))
    return grid


def two_way_difference(expected: DataFrame, observed: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys only on one side, tagged missing or extra."""
    a, b = expected.select(*keys).distinct(), observed.select(*keys).distinct()
    missing = a.join(b, list(keys), "left_anti").withColumn("side", F.lit("missing"))
    extra = b.join(a, list(keys), "left_anti").withColumn("side", F.lit("extra"))
    return missing.unionByName(extra)


def shared_groups(df: DataFrame, group: str, side: str) -> DataFrame:
    """Groups seen on more than one side of a split."""
    return (
        df.groupBy(group)
        .agg(F.count_distinct(side).alias("n_sides"))
        .filter(F.col("n_sides") > 1)
    )


def partition_check(df: DataFrame, left: str, right: str, whole: str) -> DataFrame:
    """Adds whether two array columns are disjoint and together make up the third."""
    return df.withColumn("is_disjoint", F.size(F.array_intersect(left, right)) == 0).withColumn(
        "is_complete",
        (F.size(F.array_except(F.col(whole), F.array_union(left, right))) == 0)
        & (F.size(F.array_except(F.array_union(left, right), F.col(whole))) == 0),
    )


def drop_features(df: DataFrame, features: Sequence[str], drop: Sequence[str]) -> tuple[DataFrame, list[str]]:
    """Remove features by policy; fails at plan time if one is absent."""
    absent = set(drop) - set(features) | (set(features) - set(df.columns))
    if absent:
        raise ValueError(f"unknown features: {sorted(absent)}")
    return df.drop(*drop), [f for f in features if f not in set(drop)]


#: Combinations of levels that are counted side by side in one row of a cell.
SLOTS = 16


def oof_audit(oof: DataFrame, cells: DataFrame, levels: Mapping[str, Sequence], cell: str = "cell_id") -> DataFrame:
    """Exactly-once coverage per model key: rows, distinct, missing, extra and non-finite counts.

    A cell's rows are counted in one row per SLOTS combinations of levels, beside the mark that the cell is expected, so
    what is shuffled grows with the cells. Rows of keys that no combination has are counted one by one.
    """
    keys, combinations = list(levels), list(product(*[dict.fromkeys(values) for values in levels.values()]))
    bad = finite(F.col("y_true")).isNull() | finite(F.col("y_pred")).isNull()
    whole = oof.groupBy(*keys).agg(F.count(F.lit(1)).alias("n_rows"), F.count_if(bad).alias("n_nonfinite"))

    code = F.lit(0)
    for key, values in levels.items():
        own = list(dict.fromkeys(values))
        code = code * len(own) + F.coalesce(*[F.when(F.col(key) == F.lit(x), F.lit(i)) for i, x in enumerate(own)])
    coded = oof.select(*keys, cell, code.alias("_code"))
    seen = coded.filter(F.col("_code").isNotNull()).select(cell, F.floor(F.col("_code") / SLOTS).cast("int").alias("_block"), (F.col("_code") % SLOTS).alias("_slot"), F.lit(0).alias("_want"))
    blocks = F.explode(F.sequence(F.lit(0), F.lit((len(combinations) - 1) // SLOTS)))
    wanted = cells.select(cell, blocks.alias("_block"), F.lit(None).cast("int").alias("_slot"), F.lit(1).alias("_want"))
    alone = F.when(F.col(cell).isNull(), F.col("_want"))  # a missing id equals no other
    counts = [F.count_if(F.col("_slot") == i).alias(f"_n{i}") for i in range(min(SLOTS, len(combinations)))]
    per_cell = seen.unionByName(wanted).groupBy(cell, "_block", alone.alias("_alone")).agg(F.max("_want").alias("_want"), *counts)
    slots = F.posexplode(F.array(*[f"_n{i}" for i in range(len(counts))])).alias("_slot", "_n")
    expected = F.col("_want") == 1
    known = per_cell.select("_block", "_want", slots).groupBy((F.col("_block") * SLOTS + F.col("_slot")).alias("_code")).agg(
        F.count_if(F.col("_n") > 1).alias("n_duplicated"), F.count_if(expected & (F.col("_n") == 0)).alias("n_missing"), F.count_if(~expected & (F.col("_n") > 0)).alias("n_extra"), F.max("_want").alias("_any"),
    ).filter((F.col("_code") < len(combinations)) & ((F.col("_any") == 1) | (F.col("n_extra") > 0)))
    names = F.array(*[F.struct(*[F.lit(x).cast(oof.schema[k].dataType).alias(k) for k, x in zip(keys, c, strict=True)]) for c in combinations])
    known = known.withColumn("_key", names[F.col("_code")]).select("_key.*", "n_duplicated", "n_missing", "n_extra")
    unknown = coded.filter(F.col("_code").isNull()).groupBy(*keys, cell).agg(F.count(F.lit(1)).alias("_n")).groupBy(*keys).agg(
        F.count_if(F.col("_n") > 1).alias("n_duplicated"), F.count(F.lit(1)).alias("n_extra")
    )
    parts = whole.unionByName(known, allowMissingColumns=True).unionByName(unknown, allowMissingColumns=True)
    totals = ["n_rows", "n_duplicated", "n_missing", "n_extra", "n_nonfinite"]
    return parts.groupBy(*keys).agg(*[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in totals]).withColumn(
        "exactly_once",
        (F.col("n_duplicated") + F.col("n_missing") + F.col("n_extra") + F.col("n_nonfinite")) == 0,
    )


def identity_audit(df: DataFrame, frozen: DataFrame, key: str, columns: Sequence[str]) -> DataFrame:
    """One row per column with the number of rows that differ from the frozen table, and unmatched keys."""
    right = frozen.select(key, *[F.col(c).alias(f"_f_{c}") for c in columns]).withColumn("_hit", F.lit(True))
    joined = df.select(key, *columns).join(right, key, "left")
    unmatched = F.count_if(F.col("_hit").isNull()).alias("unmatched")
    differs = [F.count_if(~F.col(c).eqNullSafe(F.col(f"_f_{c}"))).alias(c) for c in columns]
    return joined.agg(*differs, unmatched).unpivot([], [*columns, "unmatched"], "check", "n_violations")


def compare_tables(
    a: DataFrame, b: DataFrame, keys: Sequence[str], columns: Sequence[str], rtol: float = 1e-9, atol: float = 1e-12
) -> DataFrame:
    """Per column: rows on one side only, rows outside tolerance and the largest difference."""
    keys = list(keys)
    left = a.select(*keys, *[F.col(c).cast("double").alias(f"{c}_a") for c in columns], F.lit(1).alias("_a"))
    right = b.select(*keys, *[F.col(c).cast("double").alias(f"{c}_b") for c in columns], F.lit(1).alias("_b"))
    joined = left.join(right, keys, "full_outer")
    one_sided = F.count_if(F.col("_a").isNull() | F.col("_b").isNull())
    entries = []
    aggs = [one_sided.alias("_one")]
    for i, c in enumerate(columns):
        x, y = F.col(f"{c}_a"), F.col(f"{c}_b")
        both = F.col("_a").isNotNull() & F.col("_b").isNotNull()
        aggs += [
            F.count_if(both & ~is_close(x, y, rtol, atol)).alias(f"_bad{i}"),
            F.max(F.abs(x - y)).alias(f"_max{i}"),
        ]
        entries.append(
            F.struct(
                F.lit(c).alias("column"),
                F.col("_one").alias("n_one_sided"),
                F.col(f"_bad{i}").alias("n_different"),
                F.col(f"_max{i}").alias("max_abs_diff"),
            )
        )
    return joined.agg(*aggs).select(F.explode(F.array(*entries)).alias("e")).select("e.*")


def draw_table_audit(draws: DataFrame, keys: Sequence[str], replicates: int) -> DataFrame:
    """Every key must hold replicates 0..R-1 once each."""
    return (
        draws.groupBy(*keys)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.count_distinct("replicate").alias("n_distinct"),
            F.min("replicate").alias("first"),
            F.max("replicate").alias("last"),
        )
        .withColumn(
            "complete",
            (F.col("n") == replicates)
            & (F.col("n_distinct") == replicates)
            & (F.col("first") == 0)
            & (F.col("last") == replicates - 1),
        )
    )


def on_plus_one_lattice(p: Column, draws: int, atol: float = 1e-9) -> Column:
    """Whether p is k/(R+1) for a whole k >= 1."""
    scaled = p * (draws + 1)
    return (F.abs(scaled - F.round(scaled)) <= atol) & (F.round(scaled) >= 1) & (F.round(scaled) <= draws + 1)


def frozen_parameter_check(parameters: DataFrame, grid: DataFrame, keys: Sequence[str], values: Sequence[str]) -> DataFrame:
    """Parameter rows that are repeated for a key or not a member of the declared grid."""
    repeated = duplicate_keys(parameters, keys).select(*keys).withColumn("issue", F.lit("repeated"))
    foreign = (
        parameters.join(grid.select(*values).distinct(), list(values), "left_anti")
        .select(*keys)
        .withColumn("issue", F.lit("outside_grid"))
    )
    return repeated.unionByName(foreign)


def modelling_view(
    features: DataFrame, folds: DataFrame, targets: DataFrame, key: str, predictors: Sequence[str], n_folds: int
) -> tuple[DataFrame, DataFrame]:
    """Features, folds and targets joined one to one, and a table of named checks with counts."""
    reserved = {key, "group_id", "fold", "stratum"} | {c for c in targets.columns if c != key}
    illegal = sorted(reserved & set(predictors))
    if illegal:
        raise ValueError(f"keys or targets among the predictors: {illegal}")
    sides = {"features": features, "folds": folds, "targets": targets}
    marked = [d.withColumn(f"_{name}", F.lit(1)) for name, d in sides.items()]
    joined = marked[0].join(marked[1], key, "full_outer").join(marked[2], key, "full_outer")
    unmatched = [F.count_if(F.col(f"_{n}").isNull()).alias(f"missing_in_{n}") for n in sides]
    unusable = [F.count_if(F.col(p).isNull() & F.col("_features").isNotNull()).alias(f"null_{p}") for p in predictors]
    other = [F.count_if(~F.col("fold").between(0, n_folds - 1)).alias("fold_out_of_set")]
    columns = [f"missing_in_{n}" for n in sides] + [f"null_{p}" for p in predictors] + ["fold_out_of_set"]
    counts = joined.agg(*unmatched, *unusable, *other).unpivot([], columns, "check", "n")
    repeated = None
    for name, d in sides.items():
        one = duplicate_keys(d.select(key), [key]).agg(F.count(F.lit(1)).alias("n")).select(
            F.lit(f"duplicate_in_{name}").alias("check"), "n"
        )
        repeated = one if repeated is None else repeated.unionByName(one)
    crossing = shared_groups(folds, "group_id", "fold").agg(F.count(F.lit(1)).alias("n")).select(
        F.lit("group_in_several_folds").alias("check"), "n"
    )
    view = features.join(folds, key).join(targets, key)
    return view, counts.unionByName(repeated).unionByName(crossing)
