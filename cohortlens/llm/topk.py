"""Exact top-k search by a three-phase uniform threshold.

The components of the vectors are dealt out to lists; a vector's score is the sum of its local scores over the lists.
Phase 1 gathers the head of each local score list and resolves those vectors, which gives a score that k vectors reach.
Phase 2 sends every list its share of that score as a safe cutoff and collects the entries at or above it. A vector
below the cutoff in every list can't reach the score. Phase 3 resolves the vectors whose bound still reaches it.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortlens.llm.common import written

#: Vectors and queries in one block of local scores, at most on average.
VECTORS, QUERIES = 8192, 512
LISTS = 2
#: Entries that phase 1 gathers from each local list, for each of the k + 1 wanted: a longer head gives a higher safe cutoff.
HEAD = 4


def _local(vectors: np.ndarray, queries: np.ndarray) -> np.ndarray:
    """Integer inner products; as floats only where every sum stays below 2^53."""
    bound = float(np.abs(vectors).max(initial=0)) * float(np.abs(queries).max(initial=0)) * vectors.shape[1]
    if bound < 2**53:
        return queries.astype(np.float64) @ vectors.astype(np.float64).T
    return queries @ vectors.T


def _matrix(column: pd.Series, width: int) -> np.ndarray:
    out = np.zeros((len(column), width), np.int64)
    for i, v in enumerate(column):
        out[i, : len(v)] = v
    return out


def _dealt(df: DataFrame, key: str, own: int, other: int, lists: int, width: int, own_name: str, other_name: str) -> DataFrame:
    """One row per list and per block of the other side: the components of that list."""
    each = F.explode(F.sequence(F.lit(0), F.lit(lists - 1)))
    rows = df.withColumn("list", each).withColumn(own_name, F.pmod(F.xxhash64(key), F.lit(own)).cast("int"))
    rows = rows.withColumn(other_name, F.explode(F.sequence(F.lit(0), F.lit(other - 1))))
    return rows.withColumn("v", F.slice("v", F.col("list") * width + 1, width))


def _dot(a: str, b: str) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: F.coalesce(x * y, F.lit(0))), F.lit(0).cast("bigint"), lambda s, x: s + x)


def top_k(vectors: DataFrame, queries: DataFrame, k: int = 10, lists: int = LISTS) -> DataFrame:
    """(query_id, rank, vec_id, score): the k vectors with the highest inner product, ties to the smaller id.

    vectors: vec_id bigint, v array<bigint>; queries: query_id bigint, v. A vector with the query's own id takes no
    part in its list. Fewer than k vectors: all of them. Rows of one id and vector count once; shorter vectors are
    filled up with zeros; other columns are not used; empty sides give an empty table.

    Equal vectors are one class with its k + 1 smallest ids, which is all that k results without the query can need,
    so a vector that a third of the rows share is scored once. Blocks of vectors meet blocks of queries; a task holds
    one block of local scores.
    """
    spark = vectors.sparkSession
    same = W.partitionBy("v").orderBy("vec_id")
    few = vectors.select("v", "vec_id").filter(F.col("vec_id").isNotNull()).withColumn("r", F.dense_rank().over(same)).filter(F.col("r") <= k + 1)
    classes = few.groupBy("v").agg(F.array_sort(F.collect_set("vec_id")).alias("ids"))
    classes = written(classes.select(F.element_at("ids", 1).alias("cls"), F.xxhash64("v", F.element_at("ids", 1)).alias("key"), "ids", "v"), "classes")
    asked = written(queries.select("query_id", "v").filter(F.col("query_id").isNotNull()).distinct(), "queries")
    n, n_asked = classes.count(), asked.count()
    width = classes.agg(F.max(F.size("v"))).first()[0] or 1
    part = -(-width // lists)
    rows, cols = -(-n // VECTORS) or 1, -(-n_asked // QUERIES) or 1
    dealt = _dealt(classes.select("key", "v"), "key", rows, cols, lists, part, "row", "col")

    def deal_queries(df: DataFrame) -> DataFrame:
        return _dealt(df, "query_id", cols, rows, lists, part, "col", "row")

    def heads(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "v": [], "list": [], "key": [], "least": []})
        scores = _local(_matrix(left["v"], part), _matrix(right["v"], part))
        keys, m = left["key"].to_numpy(), min(HEAD * (k + 1), len(left))
        top = np.argpartition(-scores, m - 1, axis=1)[:, :m]
        at = np.repeat(np.arange(len(right)), m)
        return pd.DataFrame({
            "query_id": right["query_id"].to_numpy()[at], "v": right["q"].to_numpy()[at], "list": int(key[0]), "key": keys[top.ravel()],
            "least": scores.min(1).astype(np.int64)[at],
        })

    def reaching(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "q": [], "list": [], "key": [], "local": []})
        scores = _local(_matrix(left["v"], part), _matrix(right["v"], part))
        own = right["cuts"].map(lambda c: c[int(key[0])]).to_numpy(np.float64)
        q, c = np.nonzero(scores >= own[:, None])
        return pd.DataFrame({
            "query_id": right["query_id"].to_numpy()[q], "q": right["q"].to_numpy()[q], "list": int(key[0]),
            "key": left["key"].to_numpy()[c], "local": scores[q, c].astype(np.int64),
        })

    grid = ["list", "row", "col"]
    asked = written(asked.withColumn("q", F.xxhash64("query_id", "v")), "asked")
    # phase 1: the heads of the local lists
    first = dealt.groupBy(*grid).cogroup(deal_queries(asked).groupBy(*grid)).applyInPandas(
        heads, "query_id bigint, v bigint, list int, key bigint, least bigint"
    ).withColumnRenamed("v", "q")
    first = written(first, "heads")
    least = first.groupBy("q", "list").agg(F.min("least").alias("least")).groupBy("q").agg(
        F.array_sort(F.collect_list(F.struct("list", "least"))).alias("x")
    ).select("q", F.col("x.least").alias("least"))
    seen = first.select("q", "key").distinct()
    alone = (F.size("ids") == 1) & (F.col("cls") == F.col("query_id"))
    resolved = seen.join(asked.select("q", "query_id", F.col("v").alias("a")), "q").join(classes, "key")
    totals = resolved.filter(~alone).select("q", "key", _dot("a", "v").alias("score"))
    nth = totals.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "key"))).filter(F.col("r") == k)
    # the cutoff of a list: its lowest score and an equal share of what is missing to the k-th total
    gap = (F.col("tau") - F.aggregate("least", F.lit(0).cast("bigint"), lambda s, x: s + x)) / F.lit(float(lists))
    cuts = asked.join(least, "q").join(nth.select("q", F.col("score").alias("tau")), "q", "left").withColumn(
        "cuts", F.transform("least", lambda x: F.coalesce(x + F.floor(gap), x).cast("double"))
    )
    cuts = written(cuts, "cuts")

    # phase 2: every entry at or above its list's cutoff
    entries = dealt.groupBy(*grid).cogroup(deal_queries(cuts.select("query_id", "q", "v", "cuts")).groupBy(*grid)).applyInPandas(
        reaching, "query_id bigint, q bigint, list int, key bigint, local bigint"
    )
    got = entries.groupBy("q", "key").agg(F.sum("local").alias("known"), F.collect_set("list").alias("lists"))
    bounded = got.join(cuts.select("q", "query_id", "tau", "cuts", F.col("v").alias("a")), "q")
    missing = F.aggregate(F.transform("cuts", lambda c, i: F.when(F.array_contains("lists", i), F.lit(0.0)).otherwise(c)), F.lit(0.0), lambda s, x: s + x)
    alive = bounded.filter(F.col("tau").isNull() | (F.col("known") + missing >= F.col("tau"))).withColumn("whole", F.size("lists") == lists)
    alive = written(alive.select("q", "query_id", "key", "known", "whole", F.when(~F.col("whole"), F.col("a")).alias("a")), "alive")

    # phase 3: what some list did not send is computed in full
    rest = alive.filter(~F.col("whole")).join(classes.select("key", "v"), "key").select("q", "query_id", "key", _dot("a", "v").alias("score"))
    exact = alive.filter("whole").select("q", "query_id", "key", F.col("known").alias("score")).unionByName(rest)
    named = exact.join(classes.select("key", "cls", "ids"), "key").filter(~alone)
    best = named.withColumn("r", F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "cls"))).filter(F.col("r") <= k + 1)
    members = best.withColumn("vec_id", F.explode("ids")).filter(F.col("vec_id") != F.col("query_id"))
    rank = F.row_number().over(W.partitionBy("q").orderBy(F.desc("score"), "vec_id"))
    return members.withColumn("rank", rank).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def quantised(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """(vec_id, v): floor(1024 x) of every component; vectors that are null or hold null or non-finite components are left out."""
    v = F.col(f"`{vector_col}`").cast("array<double>")
    fine = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.filter(fine).select(F.col(f"`{id_col}`").cast("bigint").alias("vec_id"), F.transform(v, lambda x: F.floor(x * 1024.0).cast("bigint")).alias("v"))


def search(df: DataFrame, every: int = 100, k: int = 10, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """top_k for the rows whose id is divisible by `every`, against all other rows."""
    vectors = written(quantised(df, id_col, vector_col), "vectors")
    return top_k(vectors, vectors.filter(F.col("vec_id") % every == 0).withColumnRenamed("vec_id", "query_id"), k)
