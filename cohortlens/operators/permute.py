"""Sums of products of two columns, one of which is permuted inside strata many times, from blocks of values.

A permutation puts the rows of a stratum in the order of a hash, as `stratified_permutation` defines it. Rows are put in
the order of their ids once and packed; hashes are made anew from the ids where they are needed, so that what travels for
each row and iteration is its hash and its value, in arrays: one exchange by ranges of the hash, in which rows of a range
meet the values that stand at their places. Ids never travel again: rows of equal hash follow each other in the order of
ids, which is that of their blocks.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from cohortlens.functions.rng import hash32_texts
from cohortlens.operators.rankcorr import _packed, _unpacked
from cohortlens.session import measured

#: Rows packed at a time, and rows of a range of hashes on average.
BLOCK_ROWS, RANGE_ROWS = 1 << 19, 1 << 17

_BLOCK = "_b long, _n int, keys binary, parts binary, at binary, ends binary, texts binary, known binary, a binary, b binary"
_PIECE = "_k long, iteration int, _q int, _first long, _n int, h binary, v binary"
_SLOTS = -1


def _blocks(rows: DataFrame) -> DataFrame:
    """The rows (_k, _parts, _cell, _a, _b), packed in the order of _cell; blocks ascend with _b."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place, held, n = TaskContext.get().partitionId() << 32, [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= BLOCK_ROWS:
                yield packed(held, place)
                place, held, n = place + 1, [], 0
        if n:
            yield packed(held, place)

    def packed(held: list[pa.RecordBatch], place: int) -> pa.RecordBatch:
        table = pa.Table.from_batches(held).combine_chunks()
        k, parts, a, b = (table[c].to_numpy() for c in ("_k", "_parts", "_a", "_b"))
        texts = table["_text"].combine_chunks()
        texts = (texts.chunk(0) if isinstance(texts, pa.ChunkedArray) else texts).cast(pa.large_string())
        keys, first, at = np.unique(k, return_index=True, return_inverse=True)
        known = texts.is_valid().to_numpy(zero_copy_only=False)
        filled = texts.fill_null("")
        offsets = np.frombuffer(filled.buffers()[1], np.int64)[filled.offset : filled.offset + len(filled) + 1]
        text = (filled.buffers()[2] or pa.py_buffer(b"")).to_pybytes()[offsets[0] : offsets[-1]]
        row = (place, len(k), keys.tobytes(), parts[first].astype(np.int64).tobytes(), _packed(at), _packed(np.diff(offsets)), text, np.packbits(known).tobytes(), _packed(a), _packed(b))
        return pa.RecordBatch.from_arrays([pa.array([x], kind) for x, kind in zip(row, kinds, strict=True)], names=names)

    names = [c.split()[0] for c in _BLOCK.split(", ")]
    kinds = [pa.int64(), pa.int32(), *[pa.binary()] * (len(names) - 2)]
    ordered = rows.repartitionByRange("_cell").sortWithinPartitions("_cell")
    return measured(ordered.select("_k", "_parts", F.col("_cell").cast("string").alias("_text"), "_a", "_b").mapInArrow(pack, _BLOCK))


class _Block:
    """A block of rows: key number of each row, ids, and both values."""

    def __init__(self, row: dict):
        n = row["_n"]
        self.place, self.n = row["_b"], n
        self.keys, self.parts = np.frombuffer(row["keys"], np.int64), np.frombuffer(row["parts"], np.int64)
        self.at, self.a, self.b = (_unpacked(row[c], n, 1)[:, 0] for c in ("at", "a", "b"))
        ends = np.concatenate([[0], np.cumsum(_unpacked(row["ends"], n, 1)[:, 0])])
        known = np.unpackbits(np.frombuffer(row["known"], np.uint8), count=n)
        mask = pa.py_buffer(np.packbits(known, bitorder="little").tobytes())
        self.texts = pa.Array.from_buffers(pa.large_string(), n, [mask, pa.py_buffer(ends.tobytes()), pa.py_buffer(row["texts"])])

    def hashes(self, seed: int, iteration: int) -> tuple[np.ndarray, np.ndarray]:
        """Of each row, its hash and the range it lies in."""
        h = hash32_texts(f"{seed}|{'slot' if iteration == _SLOTS else iteration}", self.texts)
        return h, (h.astype(np.uint64) * self.parts[self.at].astype(np.uint64) >> np.uint64(32)).astype(np.int64)


def _each(batches: Iterator[pd.DataFrame]) -> Iterator[_Block]:
    for batch in batches:
        for row in batch.to_dict("records"):
            yield _Block(row)


def _counts(blocks: DataFrame, seed: int, n: int) -> DataFrame:
    """(_k, iteration, _q, _start): how many rows of a key lie in smaller ranges."""

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _each(batches):
            width = int(x.parts.max())
            for t in range(_SLOTS, n):
                sizes = np.bincount(x.at * width + x.hashes(seed, t)[1])
                found = np.flatnonzero(sizes)
                yield pd.DataFrame({"_k": x.keys[found // width], "iteration": np.int32(t), "_q": (found % width).astype(np.int32), "_n": sizes[found]})

    counted = blocks.mapInPandas(count, "_k long, iteration int, _q int, _n long").groupBy("_k", "iteration", "_q").agg(F.sum("_n").alias("_n"))
    upto = W.partitionBy("_k", "iteration").orderBy("_q").rowsBetween(W.unboundedPreceding, W.currentRow)
    return measured(counted.select("_k", "iteration", "_q", (F.sum("_n").over(upto) - F.col("_n")).alias("_start")))


def _pieces(blocks: DataFrame, seed: int, iterations: Sequence[int]) -> DataFrame:
    """The rows of each block by (key, iteration, range), ordered by hash and then by id; slots take b, iterations a."""

    def send(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for x in _each(batches):
            for t in iterations:
                h, q = x.hashes(seed, t)
                order = np.argsort(x.at.astype(np.uint64) << np.uint64(32) | h, kind="stable")
                at, h, q, v = x.at[order], h[order], q[order], (x.b if t == _SLOTS else x.a)[order]
                starts = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (q[1:] != q[:-1])])).tolist()
                spans = list(zip(starts, [*starts[1:], x.n], strict=True))
                out = {"_k": x.keys[at[starts]], "iteration": np.int32(t), "_q": q[starts].astype(np.int32), "_first": x.place, "_n": np.diff([*starts, x.n]).astype(np.int32)}
                yield pd.DataFrame(out | {"h": [h[i:j].tobytes() for i, j in spans], "v": [_packed(v[i:j]) for i, j in spans]})

    return blocks.mapInPandas(send, _PIECE)


def _in_order(pdf: pd.DataFrame) -> np.ndarray:
    """The values of the rows of one range in the order of their hashes, then of their ids."""
    pdf = pdf.sort_values("_first")
    values = np.concatenate([_unpacked(x, n, 1)[:, 0] for x, n in zip(pdf["v"], pdf["_n"], strict=True)])
    return values[np.argsort(np.frombuffer(b"".join(pdf["h"]), np.uint32), kind="stable")]


def _slots(blocks: DataFrame, starts: DataFrame, seed: int) -> DataFrame:
    """The values of b in the order of their slots, cut where the ranges of each iteration begin; _first: the first slot."""

    def order(pdf: pd.DataFrame) -> pd.DataFrame:
        values = _in_order(pdf)
        return pd.DataFrame({"_k": pdf["_k"].iloc[:1], "_q": pdf["_q"].iloc[:1], "_n": [len(values)], "v": [_packed(values)]})

    def listed(pdf: pd.DataFrame) -> pd.DataFrame:
        columns = {f"_{c}s": [pdf[c].to_numpy(np.int64).tobytes()] for c in ("iteration", "_q", "_start")}
        return pd.DataFrame({"_k": pdf["_k"].iloc[:1]} | columns)

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for row in batch.to_dict("records"):
                t, q, begin = (np.frombuffer(row[c], np.int64) for c in ("_iterations", "__qs", "__starts"))
                own = np.lexsort((begin, t))
                t, q, begin = t[own], q[own], begin[own]
                # A range ends where the next of its iteration begins.
                last = np.concatenate([t[1:] != t[:-1], [True]])
                end = np.where(last, np.iinfo(np.int64).max, np.concatenate([begin[1:], begin[:1]]))
                low, n = row["_start"], row["_n"]
                values = _unpacked(row["v"], n, 1)[:, 0]
                use = np.flatnonzero((begin < low + n) & (end > low))
                i, j = np.maximum(begin[use] - low, 0), np.minimum(end[use] - low, n)
                out = {"_k": row["_k"], "iteration": t[use].astype(np.int32), "_q": q[use].astype(np.int32), "_first": low + i, "_n": (j - i).astype(np.int32), "h": None}
                yield pd.DataFrame(out | {"v": [_packed(values[x:y]) for x, y in zip(i.tolist(), j.tolist(), strict=True)]})

    ordered = _pieces(blocks, seed, [_SLOTS]).groupBy("_k", "_q").applyInPandas(order, "_k long, _q int, _n int, v binary")
    places = starts.filter(F.col("iteration") == _SLOTS).select("_k", "_q", "_start")
    bounds = measured(starts.filter(F.col("iteration") != _SLOTS).groupBy("_k").applyInPandas(listed, "_k long, _iterations binary, __qs binary, __starts binary"))
    return ordered.join(places, ["_k", "_q"]).join(bounds, "_k").mapInPandas(cut, _PIECE)


def permuted_products(df: DataFrame, by: Sequence[str], stratum: str, cell: str, a: Column, b: Column, n: int, seed: int) -> DataFrame:
    """(by, iteration, dot): sums of a times b, where a row of a stratum takes the b that stands at its place in the order of slots.

    a and b are whole numbers, null counting as 0. In iteration t the rows of (by, stratum) are ordered by
    hash32(seed, t, cell), slots by hash32(seed, 'slot', cell), both then by cell. Rows with a null key take no part.
    """
    keys = [*by, stratum]
    sizes = df.dropna(subset=keys).groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / F.lit(RANGE_ROWS)).cast("int").alias("_parts"))
    keyed = measured(sizes.withColumn("_k", F.monotonically_increasing_id()))
    whole = {"_a": F.coalesce(a.cast("bigint"), F.lit(0)), "_b": F.coalesce(b.cast("bigint"), F.lit(0))}
    blocks = _blocks(df.withColumns(whole).join(keyed, keys).select("_k", "_parts", F.col(cell).alias("_cell"), "_a", "_b"))
    starts = _counts(blocks, seed, n)

    def dot(pdf: pd.DataFrame) -> pd.DataFrame:
        slots = pdf["h"].isna()
        there = pdf[slots].sort_values("_first")
        other = np.concatenate([_unpacked(x, m, 1)[:, 0] for x, m in zip(there["v"], there["_n"], strict=True)])
        product = _in_order(pdf[~slots]).astype(float) @ other.astype(float)
        return pd.DataFrame({"_k": pdf["_k"].iloc[:1], "iteration": pdf["iteration"].iloc[:1], "dot": [float(product)]})

    met = _pieces(blocks, seed, range(n)).unionByName(_slots(blocks, starts, seed)).groupBy("_k", "iteration", "_q")
    products = met.applyInPandas(dot, "_k long, iteration int, dot double").groupBy("_k", "iteration").agg(F.sum("dot").alias("dot"))
    return products.join(keyed, "_k").groupBy(*by, "iteration").agg(F.sum("dot").alias("dot"))
