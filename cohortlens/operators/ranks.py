"""Ranks, quantiles, ordered positions and multiplicity adjustment.

A window over one hot key puts that key's rows in one task. The row-level operators here
avoid that: values are counted per (key, value), each key's values are cut into ranges at
approximate percentiles (which only balance the work and never change a result), running
sums are taken inside a range, and the small per-range totals supply the offsets.
`window_ranks`, `bh_adjust` and `bh_family` are for summary tables with a few rows per key.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cohortlens.functions.numeric import finite
from cohortlens.functions.rng import UINT32
from cohortlens.session import bucket_count, cut_lineage, measured


#: Rows of a key that stay in one range. percentile_approx is exact, so independent of the order rows arrive in, up to
#: 4,999 values: the cut points of larger keys are taken over about half of CUT_ROWS rows, chosen by hash.
CUT_ROWS = 4000


def _cut_points(df: DataFrame, by: Sequence[str], key: str, weight: str, unique: Sequence[str], fractions: Sequence[float]) -> DataFrame:
    """(by, _cuts) of the keys of more than CUT_ROWS rows, the same in every evaluation of the plan.

    Rows and range totals are joined on ranges made from them, but an approximate percentile of many values follows the
    order in which shuffled blocks arrive. So it is taken over so few rows that it is exact.
    """
    counted = F.when(F.col(weight) > 0, F.col(key))
    large = df.groupBy(*by).agg(F.count(counted).alias("_rows")).filter(F.col("_rows") > CUT_ROWS)
    every = F.ceil(F.col("_rows") / F.lit(CUT_ROWS / 2)).cast("bigint")
    thinned = df.join(large, list(by)).filter(F.pmod(F.xxhash64(*by, *unique), every) == 0)
    return thinned.groupBy(*by).agg(F.percentile_approx(counted, list(fractions), 10000).alias("_cuts"))


def _with_ranges(df: DataFrame, by: Sequence[str], key: str, weight: str, buckets: int | None, unique: Sequence[str] = ()) -> DataFrame:
    """Adds _range, ascending in key. Mentioning the weight keeps the cut points on the same exchange as the rows.

    unique: columns that tell rows of one key apart besides by, if the key does not. Keys of few rows have one range.
    """
    k = 1 << max(1, (buckets or bucket_count(df)).bit_length() - 1)
    fractions = [i / k for i in range(1, k)]
    cuts = _cut_points(df, by, key, weight, [key, *unique], fractions)
    placed = df.join(cuts, list(by), "left").withColumn("_range", F.lit(0))
    step = k // 2
    while step:
        # Binary search: how many of the k-1 sorted cut points lie below the key.
        probe = F.col("_cuts")[F.col("_range") + (step - 1)] < F.col(key)
        placed = placed.withColumn("_range", F.when(probe, F.col("_range") + step).otherwise(F.col("_range")))
        step //= 2
    return placed.drop("_cuts")


def _range_offsets(ranged: DataFrame, by: Sequence[str], weight: str) -> DataFrame:
    """(by, _range, _offset, _total): weight in earlier ranges and in all ranges of the key."""
    per_range = ranged.groupBy(*by, "_range").agg(F.sum(weight).alias("_n"))
    upto = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    return per_range.select(
        *by,
        "_range",
        (F.sum("_n").over(upto) - F.col("_n")).alias("_offset"),
        F.sum("_n").over(W.partitionBy(*by)).alias("_total"),
    )


def cumulative_counts(
    df: DataFrame, by: Sequence[str], col: str, weight: str | None = None, buckets: int | None = None
) -> DataFrame:
    """One row per (by, distinct finite value) with n, n_before (rows with a smaller value), n_total."""
    by = list(by)
    w = F.col(weight) if weight else F.lit(1)
    counted = (
        df.select(*by, finite(F.col(col)).alias(col), w.cast("bigint").alias("n"))
        .filter(F.col(col).isNotNull() & (F.col("n") > 0))
        .groupBy(*by, col)
        .agg(F.sum("n").alias("n"))
    )
    ranged = _with_ranges(counted, by, col, "n", buckets)
    offsets = _range_offsets(ranged, by, "n")
    inside = W.partitionBy(*by, "_range").orderBy(col).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranged.join(offsets, [*by, "_range"]).select(
        *by,
        col,
        "n",
        (F.col("_offset") + F.sum("n").over(inside) - F.col("n")).alias("n_before"),
        F.col("_total").alias("n_total"),
    )


def _row_cuts(df: DataFrame, by: Sequence[str], columns: Sequence[str], buckets: int | None) -> DataFrame:
    """(by, a list of cut points per column) of the keys of more than CUT_ROWS rows, from about CUT_ROWS/2 rows a key.

    A value that holds more than a range's share of the rows is itself a cut point. Cut points are written out, so every
    evaluation sees the same ones; ranks do not depend on them.
    """
    k = 1 << max(1, (buckets or bucket_count(df)).bit_length() - 1)
    values = [finite(F.col(c)) for c in columns]
    counts = df.groupBy(*by).agg(*[F.count(x).alias(f"_rows{i}") for i, x in enumerate(values)])
    sizes = [F.col(f"_rows{i}") for i in range(len(columns))]
    most = F.greatest(*sizes) if len(sizes) > 1 else sizes[0]
    large = measured(counts.filter(most > CUT_ROWS))
    fractions, share = [i / k for i in range(1, k)], F.rand(0) * 2 / F.lit(CUT_ROWS)
    drawn = df.withColumn("_u", share).join(large, list(by))
    picked = [F.when((n > CUT_ROWS) & (F.col("_u") * n < 1), x) for x, n in zip(values, sizes, strict=True)]
    return measured(drawn.groupBy(*by).agg(*[F.percentile_approx(x, fractions, 10000).alias(f"_cuts{i}") for i, x in enumerate(picked)]))


def _with_row_range(df: DataFrame, by: Sequence[str], col: str, cuts: DataFrame, name: str, k: int) -> DataFrame:
    """Adds _v and _range, ascending: even between two cut points, odd on one. Small keys have range 0."""
    placed = df.join(cuts.select(*by, F.col(name).alias("_cuts")), list(by), "left").withColumns({"_v": finite(F.col(col)), "_range": F.lit(0)})
    step = k // 2
    while step:
        probe = F.get("_cuts", F.col("_range") + (step - 1)) < F.col("_v")
        placed = placed.withColumn("_range", F.when(probe, F.col("_range") + step).otherwise(F.col("_range")))
        step //= 2
    on = F.coalesce((F.get("_cuts", F.col("_range")) == F.col("_v")).cast("int"), F.lit(0))
    return placed.withColumn("_range", 2 * F.col("_range") + on)


def _row_ranks(
    df: DataFrame, by: Sequence[str], col: str, cuts: DataFrame, name: str, k: int,
    weights: Sequence[Column], out: Sequence[str], source: DataFrame, total: str | None = None,
) -> DataFrame:
    """Adds the mid-rank of each row under each weighting, moving every row once.

    Rows between two cut points meet in one window. Rows on a cut point all have one rank, known from the totals, so they
    are dealt out by the place they come from: a hot value never ends in one task.
    """
    by, names = list(by), [f"_w{i}" for i in range(len(weights))]
    wide = dict(zip(names, weights, strict=True))
    totals = _with_row_range(source.withColumns(wide), by, col, cuts, name, k).filter(F.col("_cuts").isNotNull() & F.col("_v").isNotNull())
    per_range = totals.groupBy(*by, "_range").agg(*[F.sum(w).alias(w) for w in names])
    upto = W.partitionBy(*by).orderBy("_range").rowsBetween(W.unboundedPreceding, W.currentRow)
    offsets = measured(
        per_range.select(
            *by, "_range", *[F.col(w).alias(f"_n{w}") for w in names],
            *[(F.sum(w).over(upto) - F.col(w)).alias(f"_o{w}") for w in names], F.sum(names[0]).over(W.partitionBy(*by)).alias("_rank_total"),
        )
    )
    placed = _with_row_range(df.withColumns(wide), by, col, cuts, name, k).drop("_cuts").join(offsets, [*by, "_range"], "left")
    settled = F.col("_range") % 2 == 1
    dealt = placed.withColumn("_salt", F.when(settled | F.col("_v").isNull(), F.spark_partition_id()).otherwise(F.lit(-1)))
    part = [*by, "_range", "_salt"]
    smaller = W.partitionBy(*part).orderBy("_v").rangeBetween(W.unboundedPreceding, W.currentRow)
    tied = W.partitionBy(*part, "_v")
    within = dealt.withColumns({f"_u{w}": F.sum(w).over(smaller) for w in names})
    within = within.withColumns({f"_t{w}": F.sum(w).over(tied) for w in names})
    usable = F.col("_v").isNotNull()
    for key in by:
        usable = usable & F.col(key).isNotNull()
    ranks = {}
    for w, to in zip(names, out, strict=True):
        inner = F.coalesce(F.col(f"_o{w}"), F.lit(0)) + F.col(f"_u{w}") - F.col(f"_t{w}") + (F.col(f"_t{w}") + 1) / 2.0
        ranks[to] = F.when(usable, F.when(settled, F.col(f"_o{w}") + (F.col(f"_n{w}") + 1) / 2.0).otherwise(inner))
    if total:
        own = F.sum(F.when(F.col("_v").isNotNull(), F.col(names[0]))).over(W.partitionBy(*part))
        within = within.withColumn(total, F.coalesce("_rank_total", own))
    return within.select(*df.columns, *[c.alias(to) for to, c in ranks.items()], *([total] if total else []))


def value_ranks(df: DataFrame, by: Sequence[str], columns: Mapping[str, str], share: bool = False, buckets: int | None = None) -> DataFrame:
    """Adds average-tie ranks within by, one per {column: name}; NULL for non-finite values.

    df is read a few times for cut points and totals, so it should be a table that is written out; after that every row
    moves once per column. With share=True ranks are divided by the number of finite values.
    """
    by, out = list(by), df
    k = 1 << max(1, (buckets or bucket_count(df)).bit_length() - 1)
    cuts = _row_cuts(df, by, list(columns), buckets)
    one = F.lit(1).cast("bigint")
    for i, (col, name) in enumerate(columns.items()):
        out = _row_ranks(out, by, col, cuts, f"_cuts{i}", k, [one], [name], df, "_total" if share else None)
        if share:
            out = out.withColumn(name, F.col(name) / F.col("_total")).drop("_total")
    return out


def exact_quantiles(
    df: DataFrame, by: Sequence[str], col: str, probs: Mapping[str, float], weight: str | None = None
) -> DataFrame:
    """Exact linear-interpolated quantiles per by-key, one column per entry of probs."""
    by = list(by)
    counts = cumulative_counts(df, by, col, weight)
    position = {name: (F.col("n_total") - 1) * F.lit(float(q)) for name, q in probs.items()}

    def holds(k: Column) -> Column:
        return (F.col("n_before") <= k) & (k < F.col("n_before") + F.col("n"))

    low = {name: F.floor(p) for name, p in position.items()}
    high = {name: F.ceil(p) for name, p in position.items()}
    wanted = None
    for name in probs:
        hit = holds(low[name]) | holds(high[name])
        wanted = hit if wanted is None else wanted | hit
    picked = counts.filter(wanted)
    aggs = []
    for name in probs:
        aggs += [
            F.max(F.when(holds(low[name]), F.col(col))).alias(f"_lo_{name}"),
            F.max(F.when(holds(high[name]), F.col(col))).alias(f"_hi_{name}"),
        ]
    wide = picked.groupBy(*by).agg(*aggs, F.max("n_total").alias("n_total"))
    return wide.select(
        *by,
        F.col("n_total").alias("n"),
        *[
            (
                F.col(f"_lo_{name}")
                + (F.col(f"_hi_{name}") - F.col(f"_lo_{name}")) * (position[name] - F.floor(position[name]))
            ).alias(name)
            for name in probs
        ],
    )


def ordered_index(
    df: DataFrame,
    by: Sequence[str],
    sort_key: Column,
    ties: Sequence[str],
    out: str = "position",
    total: str | None = None,
    buckets: int | None = None,
    hashed: bool = False,
) -> DataFrame:
    """Adds the 0-based position of each row within by, ordered by sort_key then ties.

    sort_key is a whole number (negate it for descending); (sort_key, ties) must be unique.
    With hashed=True the key is a uniform 32-bit hash, so equal-width ranges are already even.
    """
    by = list(by)
    keyed = df.withColumn("_key", sort_key.cast("bigint")).withColumn("_one", F.lit(1).cast("bigint"))
    if hashed:
        k = buckets or bucket_count(df)
        ranged = keyed.withColumn("_range", F.floor(F.col("_key") * k / F.lit(UINT32)))
    else:
        ranged = _with_ranges(keyed, by, "_key", "_one", buckets, ties)
    offsets = _range_offsets(ranged, by, "_one")
    inside = W.partitionBy(*by, "_range").orderBy("_key", *ties)
    placed = ranged.join(offsets, [*by, "_range"]).withColumn(
        out, F.col("_offset") + F.row_number().over(inside) - 1
    )
    if total:
        placed = placed.withColumn(total, F.col("_total"))
    return placed.drop("_key", "_one", "_range", "_offset", "_total")


def text_order_key(text: Column) -> Column:
    """Whole number that never decreases along binary text order (leading seven bytes)."""
    return F.conv(F.rpad(F.hex(F.substring(text.cast("string").cast("binary"), 1, 7)), 14, "0"), 16, 10).cast("bigint")


def window_ranks(df: DataFrame, by: Sequence[str], col: str, out: str) -> DataFrame:
    """Average-tie rank by a plain window: for tables with few rows per key."""
    tied = W.partitionBy(*by, col)
    rank = F.rank().over(W.partitionBy(*by).orderBy(col)) + (F.count(F.lit(1)).over(tied) - 1) / 2.0
    return df.withColumn(out, F.when(F.col(col).isNotNull(), rank))


def min_rank_desc(df: DataFrame, by: Sequence[str], col: str, out: str) -> DataFrame:
    """Descending rank where ties share the smallest position: for summary tables."""
    return df.withColumn(out, F.rank().over(W.partitionBy(*by).orderBy(F.desc_nulls_last(col))))


def top_k(df: DataFrame, by: Sequence[str], order: Sequence[Column], k: int, out: str = "rank") -> DataFrame:
    """First k rows per key; Spark drops the rest of each key before the shuffle."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*by).orderBy(*order))).filter(F.col(out) <= k)


def _cut(counts: DataFrame, by: Sequence[str], col: str, wanted: Column, descending: bool, cut: str, need: str) -> DataFrame:
    """(by, cut, need, _wanted): the value where the first `wanted` rows end and how many rows of that value belong."""
    ahead = F.col("n_total") - F.col("n_before") - F.col("n") if descending else F.col("n_before")
    return counts.filter((ahead < wanted) & (wanted <= ahead + F.col("n"))).select(
        *by, F.col(col).alias(cut), (wanted - ahead).alias(need), wanted.alias("_wanted")
    )


#: Rows tied on score and id prefix that one task puts in order; more are first told apart by the next bytes of their ids.
TIED_ROWS = 10_000


def top_fraction(df: DataFrame, by: Sequence[str], score: str, tie: str, fraction: float) -> DataFrame:
    """The ceil(fraction*n) rows per key with the largest score, ties broken by ascending text id.

    One row per key says at which score the top ends. Rows tied at that score are narrowed by seven bytes of their ids
    at a time: a small table says at which bytes the top ends, rows before are in, rows after are out, and only rows
    with equal bytes go on, until few are left or the ids end.
    """
    by = list(by)
    share = F.ceil(F.lit(float(fraction)) * F.col("n_total"))
    cut = cut_lineage(_cut(cumulative_counts(df, by, score), by, score, share, True, "_cut", "_need").drop("_wanted"))
    rows = df.join(cut, by)
    columns = [F.col(f"`{c}`") for c in df.columns]
    sure = rows.filter(F.col(score) > F.col("_cut")).select(*columns)
    edge, depth = rows.filter(F.col(score) == F.col("_cut")).drop("_cut"), 0
    while True:
        most = edge.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.max(F.octet_length(tie)).alias("bytes"))
        largest = most.agg(F.max("n").alias("n"), F.max("bytes").alias("bytes")).first()
        if (largest.n or 0) <= TIED_ROWS or (largest.bytes or 0) <= 7 * depth:
            break
        keyed = edge.withColumn("_id", text_order_key(F.substring(F.col(tie).cast("string").cast("binary"), 7 * depth + 1, 7).cast("string")))
        prefix = cumulative_counts(keyed.select(*by, "_id"), by, "_id").join(edge.select(*by, "_need").distinct(), by)
        ends = cut_lineage(_cut(prefix, by, "_id", F.col("_need"), False, "_idcut", "_left").drop("_wanted"))
        placed = keyed.drop("_need").join(ends, by)
        sure = sure.unionByName(placed.filter(F.col("_id") < F.col("_idcut")).select(*columns))
        edge = cut_lineage(placed.filter(F.col("_id") == F.col("_idcut")).select(*columns, F.col("_left").alias("_need")))
        depth += 1
    last = edge.withColumn("_rn", F.row_number().over(W.partitionBy(*by).orderBy(tie))).filter(F.col("_rn") <= F.col("_need"))
    return sure.unionByName(last.select(*columns))


def set_overlap(df: DataFrame, by: Sequence[str], side: str, member: str, left, right) -> DataFrame:
    """Overlap and Jaccard of two small member sets per key (top-k lists)."""
    sets = df.groupBy(*by).agg(
        F.collect_set(F.when(F.col(side) == left, F.col(member))).alias("a"),
        F.collect_set(F.when(F.col(side) == right, F.col(member))).alias("b"),
    )
    both, either = F.size(F.array_intersect("a", "b")), F.size(F.array_union("a", "b"))
    return sets.select(
        *by, both.cast("bigint").alias("overlap"), F.try_divide(both.cast("double"), either.cast("double")).alias("jaccard")
    )


def bh_adjust(df: DataFrame, by: Sequence[str], p: str, ties: Sequence[str], out: str = "bh_q") -> DataFrame:
    """Benjamini-Hochberg q-values within each family (a family is a handful of tests)."""
    family = W.partitionBy(*by)
    ranked = df.withColumn("bh_rank", F.row_number().over(family.orderBy(p, *ties))).withColumn(
        "family_n", F.count(F.lit(1)).over(family)
    )
    scaled = F.col("family_n") * F.col(p) / F.col("bh_rank")
    larger = family.orderBy(F.desc("bh_rank")).rowsBetween(W.unboundedPreceding, W.currentRow)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.min(scaled).over(larger)))


def bh_family(df: DataFrame, by: Sequence[str], p: str, ties: Sequence[str], q: float, label: str) -> DataFrame:
    """bh_adjust plus the step-up threshold, the decision and the family's name."""
    return (
        bh_adjust(df, by, p, ties)
        .withColumn("bh_threshold", F.lit(q) * F.col("bh_rank") / F.col("family_n"))
        .withColumn("rejected", F.col("bh_q") <= q)
        .withColumn("family_label", F.lit(label))
    )


def bh_input_violations(df: DataFrame, by: Sequence[str], p: str, family_size: int) -> DataFrame:
    """Families whose size or p-values break the contract; empty when all is well."""
    value = F.col(p)
    bad = value.isNull() | F.isnan(value) | (value < 0) | (value > 1)
    return (
        df.groupBy(*by)
        .agg(F.count(F.lit(1)).alias("n_tests"), F.count_if(bad).alias("n_bad"))
        .filter((F.col("n_tests") != family_size) | (F.col("n_bad") > 0))
    )


#: Where a curve begins: the state before its first epoch.
_BEGIN = -(1 << 63)


def _segment_moves(step: np.ndarray, loss: np.ndarray, entry: np.ndarray, min_delta: float, patience: int) -> tuple:
    """(from, to, loss): where the rule stands at the end of a segment, for every epoch it may stand at on entry."""
    n = len(step)
    follows, waiting = np.full(n, -1), np.arange(n)
    for ahead in range(1, n):
        waiting = waiting[waiting < n - ahead]
        waiting = waiting[step[waiting + ahead] <= step[waiting] + patience]
        if not len(waiting):
            break
        better = np.isnan(loss[waiting]) | (loss[waiting + ahead] < loss[waiting] - min_delta)
        follows[waiting[better]] = waiting[better] + ahead
        waiting = waiting[~better]
    end = list(range(n))
    for i, after in zip(range(n - 1, -1, -1), follows[::-1].tolist(), strict=True):
        if after >= 0:
            end[i] = end[after]
    entry = np.flatnonzero(entry)
    come = step[entry].tolist() if len(entry) else [_BEGIN]
    at = [end[i] for i in entry] if len(entry) else [end[0]]
    return come, step[at].tolist(), loss[at].tolist()


def _joined_moves(segment: np.ndarray, come: np.ndarray, to: np.ndarray, loss: np.ndarray) -> tuple:
    """Moves of neighbouring segments, in order, as one: what no segment moves stays where it is."""
    states, turns = None, (np.flatnonzero(np.diff(segment)) + 1).tolist()
    for low, high in zip([0, *turns], [*turns, len(segment)], strict=True):
        ends = zip(to[low:high].tolist(), loss[low:high].tolist(), strict=True)
        moves = dict(zip(come[low:high].tolist(), ends, strict=True))
        states = moves if states is None else {k: moves.get(v[0], v) for k, v in states.items()}
    ends, losses = zip(*states.values(), strict=True)
    return list(states), ends, losses


def _moves_of(df: DataFrame, run: str, segment: Column, order: Sequence[str], work: Callable, schema: T.StructType) -> DataFrame:
    """work on the rows of each (run, segment), in order. Rows come sorted, so a task goes from one to the next in a stream
    and holds one at a time: short curves by the million cost no more than their rows."""
    rows = df.withColumn("_of", segment).repartition(run, "_of").sortWithinPartitions(run, "_of", *order)

    def stream(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None
        for batch in batches:
            if not len(batch):
                continue
            pdf = batch if held is None else pd.concat([held, batch], ignore_index=True)
            runs, own = pdf[run].to_numpy(), pdf["_of"].to_numpy()
            starts = np.flatnonzero(np.concatenate([[True], (runs[1:] != runs[:-1]) | (own[1:] != own[:-1])])).tolist()
            if len(starts) > 1:
                yield _results(pdf, starts)
            held = pdf.iloc[starts[-1] :]
        if held is not None:
            yield _results(held, [0, len(held)])

    def _results(pdf: pd.DataFrame, starts: list[int]) -> pd.DataFrame:
        columns = [pdf[c].to_numpy() for c in names]
        at, out = [], ([], [], [])
        for low, high in zip(starts, starts[1:], strict=False):
            made = work(*[c[low:high] for c in columns])
            at += [low] * len(made[0])
            for column, values in zip(out, made, strict=True):
                column.extend(values)
        return pd.DataFrame({run: pdf[run].to_numpy()[at], "_segment": pdf["_of"].to_numpy()[at], "_from": out[0], "_to": out[1], "_loss": out[2]})

    names = [c for c in df.columns if c != run and (c != "_segment" or "_from" in df.columns)]
    return rows.mapInPandas(stream, schema)


def early_stopping(
    df: DataFrame, run: str, step: str, loss: str, min_delta: float, patience: int, chunk: int = 4096, merged: int = 512
) -> DataFrame:
    """Where each learning curve would stop: an epoch counts only if it beats the best by min_delta (0 or more).

    A curve is cut into segments of `chunk` epochs (`patience`, if that is more). The rule can only move on from the
    last `patience` epochs before a segment, so a segment is a small table of moves from each of them to where the rule
    stands at its end. Moves of neighbours are joined, `merged` at a time, until one table is left for a curve: no task sees
    more than a segment or so many tables, whatever the length of the curve.

    Rows of one epoch count with their least loss. A null or NaN loss improves nothing, and any later epoch in reach
    improves on it. Rows without a step count in n_steps only. An empty table gives an empty table.
    """
    if min_delta < 0:
        raise ValueError("min_delta must be 0 or more")
    size, at = max(chunk, patience, 1), F.col("_step")
    rows = df.filter(F.col(run).isNotNull()).select(run, F.col(step).cast("bigint").alias("_step"), F.col(loss).cast("double").alias("_loss"))
    points = rows.filter(at.isNotNull()).groupBy(run, "_step").agg(F.min("_loss").alias("_loss"))
    bounds = points.agg(F.min("_step"), F.max("_step")).first()
    begin, span = bounds[0] or 0, ((bounds[1] or 0) - (bounds[0] or 0)) // size
    own = F.floor((at - begin) / F.lit(size)).cast("bigint")
    placed = points.withColumns({"_segment": own, "_entry": F.lit(False)})
    handed = placed.filter(at - begin >= (F.col("_segment") + 1) * size - patience)
    placed = placed.unionByName(handed.withColumns({"_segment": F.col("_segment") + 1, "_entry": F.lit(True)}))
    key = T.StructType([df.schema[run]])
    for name, kind in (("_segment", T.LongType()), ("_from", T.LongType()), ("_to", T.LongType()), ("_loss", T.DoubleType())):
        key = key.add(name, kind)
    placed = placed.select(run, "_segment", "_step", "_loss", "_entry")
    moves = _moves_of(placed, run, F.col("_segment"), ["_step"], lambda *columns: _segment_moves(*columns, min_delta, patience), key)
    span += 1  # the last segment is handed on as well
    while span:
        moves = _moves_of(moves, run, F.floor(F.col("_segment") / merged), ["_segment"], _joined_moves, key)
        span //= merged
    last = rows.groupBy(run).agg(F.max("_step").alias("last_step"), F.count(F.lit(1)).alias("n_steps"))
    return moves.filter(F.col("_from") == _BEGIN).join(last, run).select(
        run,
        "n_steps",
        F.col("_to").alias("best_step"),
        F.col("_loss").alias("best_loss"),
        F.least(F.col("_to") + patience, F.col("last_step")).alias("stop_step"),
        (F.col("_to") + patience <= F.col("last_step")).alias("stopped_early"),
    )

