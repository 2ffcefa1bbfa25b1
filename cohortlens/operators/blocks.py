"""Samples x sets = (samples x genes) . (genes x sets), as a product of sparse blocks.

Samples, genes and sets are dealt out to blocks by hash. A task holds the values of one block of samples and one of genes
and the weights of that block of genes and one of sets, and makes their partial product; partial products are summed over
the blocks of genes. Every block is of bounded size, whatever gene occurs in whatever many sets, and no list of sets or
samples travels with a row.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Samples, sets and genes in one block, on average.
SAMPLES, SETS, GENES = 512, 512, 8192


def _dealt(key: Column, blocks: int) -> Column:
    return F.pmod(key, F.lit(blocks)).cast("int")


def _each(blocks: int) -> Column:
    return F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))


def set_products(values: DataFrame, samples: DataFrame, sets: DataFrame, keys: Sequence[str], weights: Sequence[str]) -> DataFrame:
    """(sample_id, keys, weights): per sample and set, each weight column times the sample's values, summed over the set's genes.

    values (sample_id, gene, x), where an absent or null value is 0; samples (sample_id); sets (keys, gene, weights). Every
    sample meets every set, also without a value in common. Repeated rows of values and sets add up, sample ids are
    distinct; values of other samples are left out. No samples or no sets: an empty table.
    """
    keys, weights = list(keys), list(weights)
    genes = sets.select("gene").distinct()
    n_samples, n_sets, n_genes = samples.count(), sets.select(*keys).distinct().count(), genes.count()
    sb, kb, gb = (max(1, -(-n // size)) for n, size in ((n_samples, SAMPLES), (n_sets, SETS), (n_genes, GENES)))
    own = samples.select("sample_id", _each(gb).alias("_g"), F.lit(None).cast("string").alias("gene"), F.lit(None).cast("double").alias("x"))
    hits = values.join(genes, "gene", "left_semi").select("sample_id", _dealt(F.xxhash64("gene"), gb).alias("_g"), "gene", F.col("x").cast("double").alias("x"))
    left = own.unionByName(hits).withColumn("_s", _dealt(F.xxhash64("sample_id"), sb)).withColumn("_k", _each(kb))
    right = sets.select(*keys, "gene", *[F.col(w).cast("double").alias(w) for w in weights]).withColumns(
        {"_h": _dealt(F.xxhash64("gene"), gb), "_l": _dealt(F.xxhash64(*keys), kb)}
    ).withColumn("_t", _each(sb))
    kinds = {f.name: f.dataType.simpleString() for f in [*samples.select("sample_id").schema, *sets.select(*keys).schema]}

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame(columns=["sample_id", *keys, *weights])
        ids = pd.Index(left["sample_id"][left["gene"].isna()])  # the rows of samples themselves
        row = ids.get_indexer(left["sample_id"])
        column = right.groupby(keys, sort=False, dropna=False).ngroup().to_numpy()
        named = right[keys].iloc[np.unique(column, return_index=True)[1]]
        names = pd.Index(right["gene"].dropna().unique())
        place, own = names.get_indexer(left["gene"]), names.get_indexer(right["gene"])
        known, told = (row >= 0) & (place >= 0) & left["x"].notna().to_numpy(), own >= 0
        x = np.zeros((len(ids), len(names)))
        np.add.at(x, (row[known], place[known]), left["x"].to_numpy()[known])
        out = named.loc[named.index.repeat(len(ids))].reset_index(drop=True)
        out.insert(0, "sample_id", np.tile(np.asarray(ids, object), len(named)))
        for w in weights:
            by_set = np.zeros((len(named), len(names)))
            np.add.at(by_set, (column[told], own[told]), right[w].fillna(0.0).to_numpy()[told])
            out[w] = (by_set @ x.T).ravel()
        return out

    schema = ", ".join([f"`{c}` {kinds[c]}" for c in ("sample_id", *keys)] + [f"`{w}` double" for w in weights])
    parts = left.groupBy("_s", "_k", "_g").cogroup(right.groupBy("_t", "_l", "_h")).applyInPandas(product, schema)
    if gb == 1:
        return parts
    return parts.groupBy("sample_id", *keys).agg(*[F.sum(w).alias(w) for w in weights])
