"""Mixing sources to target weights: capped water-filling, then seeded whole and fractional repetitions.

DataFrame operations only. The driver sees a few sums per round, never rows.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortlens.llm.common import positions, size, written

BUCKETS = 4096
SALTS = 32


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def _draw(id_: Column, seed: int) -> Column:
    text = F.concat_ws("|", F.lit(str(seed)), F.coalesce(id_.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")


def water_fill(sources: DataFrame, total: int, share: float, max_epochs: float) -> DataFrame:
    """Adds target to (weight, source_size): share * total by weight, none above max_epochs * source_size.

    A source whose part exceeds its cap is clamped and the excess goes to the others by weight. The clamped set only
    grows, so a round is one sum over the sources, and the rounds end when it stays the same.
    """
    cap, weight = F.lit(float(max_epochs)) * F.col("source_size"), F.col("weight")
    level = 0.0
    while True:
        clamped = cap < weight * F.lit(level)
        sums = sources.agg(
            F.sum(F.when(clamped, cap)).alias("fixed"), F.sum(F.when(~clamped, weight)).alias("open")
        ).first()
        if not sums.open:
            return sources.withColumn("target", cap)
        raised = (share * total - (sums.fixed or 0.0)) / sums.open
        if raised <= level:
            return sources.withColumn("target", F.when(clamped, cap).otherwise(weight * F.lit(level)))
        level = raised


def mix_sources(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source",
    weights: Sequence[int] = (3, 1, 2), share: float = 1.5, max_epochs: float = 2, seed: int = 7,
) -> DataFrame:
    """(row, size, source_size, target, copies) for each row of docs: how often the mix repeats it.

    Size is the number of words (null text: 0). Sources in code-point order, null last (a source of its own), get the
    weights in turn. A source's target is met by whole repetitions of all its rows and one more repetition of the
    rows that come first in a seeded order; the last of them is taken if at least half of it is needed. Rows with
    equal ids share their place in that order, so a repeated row is treated like its copy. A null id is an id. Texts
    without words have size 0. An empty table gives an empty table. row is a struct of all columns of docs, which may
    have any names.

    The seeded order is cut into 4096 ranges of a hash; sums per (source, range) say in which range a source's cut
    lies, and only that range's rows are ordered. A source with a third of all rows is thus never in one task.
    """
    spark = docs.sparkSession
    own = docs.select(
        F.col(f"`{id_col}`").alias("id"), F.col(f"`{source_col}`").alias("source"), size(F.col(f"`{text_col}`")).alias("size")
    )
    sizes = written(
        own.select(
            F.coalesce(F.col("id").cast("string"), F.lit("")).alias("id"), "source", _key(F.col("source")).alias("key"), "size",
            _draw(F.col("id"), seed).alias("draw"),
        ),
        "sizes",
    )
    sources = sizes.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    placed = positions(sources, [F.col("source").asc_nulls_last()], "place")
    turn = F.array(*[F.lit(float(w)) for w in weights])
    placed = written(placed.withColumn("weight", F.element_at(turn, (F.col("place") % len(weights) + 1).cast("int"))), "sources")
    total = placed.agg(F.sum("source_size")).first()[0] or 0
    targets = water_fill(placed, total, share, max_epochs)
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("bigint")
    targets = targets.withColumn("whole", whole).withColumn("part", F.col("target") - F.col("whole") * F.col("source_size"))
    cuts = written(_cuts(sizes, targets), "cuts")

    salted = cuts.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    rows = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), _key(F.col(f"`{source_col}`")).alias("key"),
        _draw(F.col(f"`{id_col}`"), seed).alias("draw"), size(F.col(f"`{text_col}`")).alias("size"),
        F.coalesce(F.col(f"`{id_col}`").cast("string"), F.lit("")).alias("id"),
    ).withColumn("salt", (F.col("draw") % SALTS).cast("int"))
    extra = F.coalesce(F.struct("draw", "id") <= F.struct("cut_draw", "cut_id"), F.lit(False)).cast("bigint")
    joined = rows.join(salted.select("key", "salt", "source_size", "target", "whole", "cut_draw", "cut_id"), ["key", "salt"])
    return joined.select("row", "size", "source_size", "target", (F.col("whole") + extra).alias("copies"))


def _cuts(sizes: DataFrame, targets: DataFrame) -> DataFrame:
    """Per source the last (draw, id) that the extra repetition takes; null if it takes none."""
    range_of = F.floor(F.col("draw") * BUCKETS / 4294967296).cast("int")
    ranged = sizes.select("key", range_of.alias("range"), "draw", "id", "size")
    sums = ranged.groupBy("key", "range").agg(F.sum("size").alias("n"))
    sums = sums.withColumn("before", F.sum("n").over(W.partitionBy("key").orderBy("range")) - F.col("n"))
    at = sums.join(targets.select("key", "part"), "key").filter(F.col("before") <= F.col("part"))
    last = at.groupBy("key").agg(F.max_by(F.struct("range", "before", "part"), "range").alias("x")).select("key", "x.*")
    edge = ranged.join(last, ["key", "range"]).groupBy("key", "range", "before", "part", "draw", "id").agg(F.sum("size").alias("n"))
    ahead = F.sum("n").over(W.partitionBy("key").orderBy("draw", "id")) - F.col("n") + F.col("before")
    taken = edge.withColumn("ahead", ahead).filter((F.col("part") > 0) & (2 * F.col("ahead") + F.col("n") <= 2 * F.col("part")))
    inside = taken.groupBy("key").agg(F.max(F.struct("draw", "id")).alias("cut"))
    # where not even the first of the range is taken, the cut lies just before the range
    whole_range = F.floor(F.col("range") * F.lit(4294967296) / BUCKETS) - 1
    return targets.join(last.select("key", "range"), "key", "left").join(inside, "key", "left").select(
        targets["*"], F.coalesce(F.col("cut.draw"), F.ceil(whole_range)).alias("cut_draw"),
        F.coalesce(F.col("cut.id"), F.lit("\U0010ffff")).alias("cut_id"),
    )


def repeated(docs: DataFrame, **settings) -> DataFrame:
    """The mixed corpus: each row as often as the mix takes it, with the columns of docs."""
    mixed = mix_sources(docs, **settings).filter(F.col("copies") > 0)
    return mixed.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
