"""Hard negatives for anchors, with score bounds passed down spanning trees of anchors.

The anchors are put in blocks; the anchors of a block form a minimum spanning tree. If s is the score of a candidate c
with a parent anchor, then its score with the child anchor is between s - d * |c| and s + d * |c|, d being the length of
the edge. A block of candidates is scored in full with the root only; a child anchor scores those whose bounds overlap a
window in which it looks for results, and passes the bounds of the others on to its own children.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortlens.llm.common import positions, written

#: Anchors in a block; candidates in a block on average, fewer where vectors have many components.
ANCHORS, CANDIDATES, COMPONENTS = 256, 8192, 1 << 20


def spanning_tree(v: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(order, parent, edge): rows from the root on, each after its parent; the root's parent is -1.

    The root is the row nearest to the mean of all; then the row nearest to the tree is added again and again.
    """
    n = len(v)
    x = v.astype(np.float64)
    near = np.linalg.norm(x - x.mean(0), axis=1)
    order, parent, edge = [int(near.argmin())], np.full(n, -1), np.zeros(n)
    best, whose = np.full(n, np.inf), np.full(n, -1)
    outside = np.ones(n, bool)
    outside[order[0]] = False
    while len(order) < n:
        last = order[-1]
        d = np.linalg.norm(x - x[last], axis=1)
        closer = d < best
        best[closer], whose[closer] = d[closer], last
        new = int(np.where(outside, best, np.inf).argmin())
        parent[new], edge[new], outside[new] = whose[new], best[new], False
        order.append(new)
    return np.array(order), parent, edge


class Scorer:
    """Exact integer scores of one block of candidates: as floats only where every sum stays below 2^53."""

    def __init__(self, vectors: np.ndarray, anchors: np.ndarray):
        most = float(np.abs(vectors).max(initial=0)) * float(np.abs(anchors).max(initial=0)) * max(1, vectors.shape[1])
        self.kind = np.float64 if most < 2**53 else np.int64
        self.x = vectors.astype(self.kind)
        self.norm = np.linalg.norm(vectors.astype(np.float64), axis=1)

    def __call__(self, anchor: np.ndarray, at=slice(None)) -> np.ndarray:
        return (self.x[at] @ anchor.astype(self.kind)).astype(np.int64)


def walk(scorer: Scorer, anchors: np.ndarray, order, parent, edge, wanted):
    """Yields (anchor, candidates, scores) down the tree: every candidate that wanted(anchor, low, high) picks, scored exactly.

    low and high bound the candidates' scores. At the root both are the scores themselves.
    """
    bounds: dict[int, tuple[np.ndarray, np.ndarray]] = {}
    children = np.bincount(parent[parent >= 0], minlength=len(order))
    for a in order:
        if parent[a] < 0:
            low = high = scorer(anchors[a]).astype(np.float64)
        else:
            above_low, above_high = bounds[parent[a]]
            # a little wider than the bound, for the rounding of distance, norm and product
            reach = edge[a] * scorer.norm * (1 + 1e-9) + 1e-9 * np.abs(above_high) + 1
            low, high = above_low - reach, above_high + reach
            children[parent[a]] -= 1
            if not children[parent[a]]:
                del bounds[parent[a]]
        at = np.flatnonzero(wanted(a, low, high))
        scores = scorer(anchors[a], at)
        if children[a]:
            low, high = low.copy(), high.copy()
            low[at] = high[at] = scores
            bounds[a] = low, high
        yield a, at, scores


def _first(scores: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k highest scores, ties by smaller id."""
    if len(scores) > k:
        fine = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
        return fine[np.lexsort((ids[fine], -scores[fine]))[:k]]
    return np.lexsort((ids, -scores))


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _trees(anchors: DataFrame, width: int) -> DataFrame:
    """The anchors with their block, place in the tree's order, the place of their parent and the length of the edge to it."""
    placed = positions(anchors, [F.col("label"), F.col("vec_id"), F.col("mark")], "at")  # like labels lie side by side
    blocked = placed.withColumn("block", F.floor(F.col("at") / ANCHORS).cast("int")).drop("at")

    def tree(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["label", "vec_id", "mark"], ignore_index=True)
        order, parent, edge = spanning_tree(_matrix(rows["v"], width))
        place = np.argsort(order)
        rows["place"], rows["parent"], rows["edge"] = place, np.where(parent < 0, -1, place[parent]), edge
        return rows

    return written(blocked.groupBy("block").applyInPandas(tree, "vec_id bigint, label bigint, v array<bigint>, mark bigint, block int, place int, parent int, edge double"), "trees")


def mine(rows: DataFrame, every: int = 50, positives: int = 5, negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of rows with vec_id, label and v bigint, bigint, array<bigint>.

    Anchors are the rows whose vec_id is divisible by `every`, their positives the first rows of the same label and
    another vec_id, the negatives of a positive the first rows of other labels with low % to high % of its score.
    First: the higher integer inner product, then the smaller vec_id. Rows with a null in any of the three take no
    part, equal rows count once, rows of one vec_id that differ are rows each for itself, anchors too; shorter vectors
    are filled up with zeros. No rows or no anchors: an empty table.

    Blocks of anchors meet blocks of candidates and send on their best few, so no anchor, label or vector gathers rows.
    """
    rows = rows.select(F.col("vec_id").cast("bigint").alias("vec_id"), F.col("label").cast("bigint").alias("label"), "v").dropna()
    rows = written(rows.withColumn("mark", F.xxhash64("label", "v")).distinct(), "rows")
    n, width = rows.agg(F.count(F.lit(1)), F.max(F.size("v"))).first()
    width = width or 1
    blocks = max(1, -(-n // max(1, min(CANDIDATES, COMPONENTS // width))))
    trees = _trees(rows.filter(F.col("vec_id") % every == 0), width)
    candidates = rows.select("vec_id", "label", "v", F.pmod(F.xxhash64("vec_id", "mark"), F.lit(blocks)).cast("int").alias("share"))

    def anchors_of(left: pd.DataFrame, right: pd.DataFrame):
        left = left.sort_values("place", ignore_index=True)
        v = _matrix(left["v"], width)
        return left, v, Scorer(_matrix(right["v"], width), v), right["vec_id"].to_numpy(), right["label"].to_numpy()

    def nearest(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            left, v, scorer, ids, labels = anchors_of(left, right)
            own, label = left["vec_id"].to_numpy(), left["label"].to_numpy()

            def wanted(a, lo, hi):
                fits = (labels == label[a]) & (ids != own[a])
                least = lo[fits]
                return fits & (hi >= np.partition(least, len(least) - positives)[len(least) - positives]) if len(least) > positives else fits

            for a, at, scores in walk(scorer, v, np.arange(len(v)), left["parent"].to_numpy(), left["edge"].to_numpy(), wanted):
                best = _first(scores, ids[at], positives)
                found += [(own[a], left["mark"][a], ids[at[i]], scores[i]) for i in best]
        return pd.DataFrame(found, columns=["anchor_id", "mark", "positive_id", "positive_score"]).astype("int64")

    # a candidate goes to the blocks that hold anchors of its label
    places = trees.select("block", "label").distinct()
    sides = places.select("block").distinct().withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    alike = candidates.join(places.withColumnRenamed("block", "to"), "label")
    met = trees.join(sides, "block").groupBy("block", "part").cogroup(alike.groupBy("to", "share"))
    pairs = met.applyInPandas(nearest, "anchor_id bigint, mark bigint, positive_id bigint, positive_score bigint")
    place = F.row_number().over(W.partitionBy("anchor_id", "mark").orderBy(F.desc("positive_score"), "positive_id"))
    chosen = written(pairs.withColumn("place", place).filter(F.col("place") <= positives), "positives")

    def hard(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        found = []
        if len(left) and len(right):
            left, v, scorer, ids, labels = anchors_of(left, right)
            own, label, goals = left["vec_id"].to_numpy(), left["label"].to_numpy(), [np.array(g, np.int64) for g in left["goals"]]

            def wanted(a, lo, hi):
                inside = np.zeros(len(ids), bool)
                for goal in goals[a]:
                    inside |= (100 * hi >= low * goal) & (100 * lo <= high * goal)
                return inside & (labels != label[a])

            for a, at, scores in walk(scorer, v, np.arange(len(v)), left["parent"].to_numpy(), left["edge"].to_numpy(), wanted):
                for goal in goals[a]:
                    fits = np.flatnonzero((100 * scores >= low * goal) & (100 * scores <= high * goal))
                    best = fits[_first(scores[fits], ids[at[fits]], negatives)]
                    found += [(own[a], left["mark"][a], goal, ids[at[i]], scores[i]) for i in best]
        return pd.DataFrame(found, columns=["anchor_id", "mark", "positive_score", "negative_id", "negative_score"]).astype("int64")

    goals = chosen.groupBy("anchor_id", "mark").agg(F.collect_set("positive_score").alias("goals"))  # at most `positives` each
    aimed = trees.join(goals.withColumnRenamed("anchor_id", "vec_id"), ["vec_id", "mark"], "left").withColumn("goals", F.coalesce("goals", F.array().cast("array<bigint>")))
    last = places.agg(F.max("block")).first()[0] or 0
    spread = candidates.withColumn("to", F.explode(F.sequence(F.lit(0), F.lit(last))))
    tried = aimed.join(sides, "block").groupBy("block", "part").cogroup(spread.groupBy("to", "share"))
    nears = tried.applyInPandas(hard, "anchor_id bigint, mark bigint, positive_score bigint, negative_id bigint, negative_score bigint")
    goal = ["anchor_id", "mark", "positive_score"]
    rank = F.row_number().over(W.partitionBy(*goal).orderBy(F.desc("negative_score"), "negative_id"))
    ranked = nears.withColumn("rank", rank).filter(F.col("rank") <= negatives)
    return chosen.join(ranked, goal).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def labelled(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label", scale: float = 256.0) -> DataFrame:
    """(vec_id, label, v): floor(scale * x) of every component.

    Rows with a null id, label or vector, or a null or non-finite component, are left out. Where the id is divisible
    by 7 the label is moved on by one of ten.
    """
    v, key, label = F.col(f"`{vector_col}`").cast("array<double>"), F.col(f"`{id_col}`").cast("bigint"), F.col(f"`{label_col}`").cast("bigint")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & key.isNotNull() & label.isNotNull()
    moved = F.when(key % 7 == 0, (label + 1) % 10).otherwise(label)
    return df.filter(fine).select(key.alias("vec_id"), moved.alias("label"), F.transform(v, lambda x: F.floor(x * scale).cast("bigint")).alias("v"))
