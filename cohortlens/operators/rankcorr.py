"""Spearman correlation of long columns, also under many weightings at once, from blocks of values.

Rows are packed into blocks (the values of one key in a stretch of a partition), so that what is read and shuffled are
arrays. Each column is cut at a few points per key, which only balance the work: values between two cut points meet in
one task and are sorted there, values on a cut point all have one rank, known from the totals, and stay dealt out. Two
exchanges do: by ranges of the first column, then by ranges of the second. Rows whose second value lies on a cut point
need no second one: a column of few different values has them all as cut points.

Ranks are doubled and taken about their mean, so they are whole numbers, and sums over a range are shifted afterwards.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.functions.numeric import finite
from cohortlens.session import cut_lineage, measured

#: Rows packed at a time, rows of a range on average, and different values that are all taken as cut points.
BLOCK_ROWS, RANGE_ROWS, FEW_VALUES = 1 << 19, 1 << 17, 2048
#: Bytes of weights held while rows of many lanes are packed.
HELD_BYTES = 1 << 27

#: Kinds of sums: rows by range of the first and of the second column; squares of the first column's ranks; then per
#: range of the second column: ranks of the first, products, squares and ranks of the second.
_NA, _NB, _AA, _A, _AB, _BB, _B = range(7)


def _f8(data: bytes) -> np.ndarray:
    return np.frombuffer(data, np.float64)


def _packed(values: np.ndarray) -> bytes:
    """Whole numbers in the fewest of 1, 2, 4 or 8 bytes; a column of n x lanes of them tells its width by its length."""
    low, high = (int(values.min()), int(values.max())) if values.size else (0, 0)
    for kind in (np.int8, np.int16, np.int32):
        if np.iinfo(kind).min <= low and high <= np.iinfo(kind).max:
            return values.astype(kind).tobytes()
    return values.astype(np.int64).tobytes()


def _unpacked(data: bytes, n: int, lanes: int) -> np.ndarray:
    width = len(data) // max(1, n * lanes)
    return np.frombuffer(data, {0: np.int8, 1: np.int8, 2: np.int16, 4: np.int32, 8: np.int64}[width]).reshape(n, lanes).astype(np.int64)


def _runs(sorted_keys: np.ndarray) -> Iterator[tuple[int, int]]:
    starts = np.flatnonzero(np.concatenate([[True], sorted_keys[1:] != sorted_keys[:-1]])).tolist() if len(sorted_keys) else []
    yield from zip(starts, [*starts[1:], len(sorted_keys)], strict=True)


def _placed(values: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """Ascending ranges: even between two cut points, odd on one."""
    if not len(cuts):
        return np.zeros(len(values), np.int32)
    at = np.searchsorted(cuts, values, side="left")
    on = at < len(cuts)
    on[on] = cuts[at[on]] == values[on]
    return (2 * at + on).astype(np.int32)


def _local_ranks(ordered: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Doubled weight below each of the ascending values plus the weight tied with it (n x lanes)."""
    upto = np.cumsum(weight, axis=0)
    first = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if first.all():
        upto *= 2
        upto -= weight
        return upto
    starts = np.flatnonzero(first)
    high = upto[np.concatenate([starts[1:], [len(ordered)]]) - 1]
    both = high.copy()
    both[1:] += high[:-1]
    return both[np.cumsum(first) - 1]


def _blocks(df: DataFrame, lanes: int, batches: int = 0) -> DataFrame:
    """(_k, _n, a, b, w): the rows (_k, _a, _b and weights) packed by key, at most BLOCK_ROWS at a time.

    Weights are a column of whole numbers for each lane or, with batches, one column _w of a byte for each lane of so many
    batches; those of batch i make blocks of key _k * batches + i.
    """
    names = ["_w"] if batches else [f"_w{i}" for i in range(lanes)]
    most = max(1, min(BLOCK_ROWS, HELD_BYTES // (lanes * batches))) if batches else BLOCK_ROWS

    def weights(held: list[pa.RecordBatch], n: int) -> np.ndarray | None:
        if not batches:
            return np.stack([column(held, c) for c in names], axis=1) if names else None
        return np.frombuffer(b"".join(x for p in held for x in p.column("_w").to_pylist()), np.uint8).reshape(n, lanes * batches)

    def column(held: list[pa.RecordBatch], c: str) -> np.ndarray:
        return np.concatenate([p.column(c).to_numpy(zero_copy_only=False) for p in held])

    def packed(held: list[pa.RecordBatch], n: int) -> Iterator[pa.RecordBatch]:
        key, a, b, w = column(held, "_k"), column(held, "_a"), column(held, "_b"), weights(held, n)
        order = np.argsort(key, kind="stable")
        key, a, b = key[order], a[order], b[order]
        kinds = (pa.int64(), pa.int64(), pa.binary(), pa.binary(), pa.binary())
        for i, j in _runs(key):
            parts = [None] if w is None else [_packed(w[order[i:j], x * lanes : (x + 1) * lanes]) for x in range(batches or 1)]
            rows = [(key[i] * (batches or 1) + x, j - i, a[i:j].tobytes(), b[i:j].tobytes(), part or b"") for x, part in enumerate(parts)]
            yield pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(zip(*rows, strict=True), kinds, strict=True)], names=["_k", "_n", "a", "b", "w"])

    def pack(arrived: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in arrived:
            held.append(batch)
            n += batch.num_rows
            if n >= most:
                yield from packed(held, n)
                held, n = [], 0
        if n:
            yield from packed(held, n)

    return df.select("_k", "_a", "_b", *names).mapInArrow(pack, "_k long, _n long, a binary, b binary, w binary")


def _cuts(blocks: DataFrame) -> DataFrame:
    """(_k, _ca, _cb): cut points of both columns, from at most 1024 values of a block; none for keys of one range."""

    def draw(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pick = np.random.default_rng(0)
        for batch in batches:
            drawn = [pick.integers(0, n, min(1024, max(16, n // 128))) for n in batch["_n"]]
            for c in ("a", "b"):
                batch[c] = [_f8(x)[i].tobytes() for x, i in zip(batch[c], drawn, strict=True)]
            yield batch[["_k", "_n", "a", "b"]]

    def cut(pdf: pd.DataFrame) -> pd.DataFrame:
        parts, out = -(-int(pdf["_n"].sum()) // RANGE_ROWS), []
        for c in ("a", "b"):
            values = np.sort(_f8(b"".join(pdf[c])))
            different = np.unique(values)
            if len(different) > FEW_VALUES or 4 * len(different) > len(values):
                different = np.unique(values[np.arange(1, parts) * len(values) // parts])
            out.append(different.tobytes() if parts > 1 else b"")
        return pd.DataFrame({"_k": pdf["_k"].iloc[:1], "_ca": out[:1], "_cb": out[1:]})

    drawn = blocks.select("_k", "_n", "a", "b").mapInPandas(draw, "_k long, _n long, a binary, b binary")
    return measured(drawn.groupBy("_k").applyInPandas(cut, "_k long, _ca binary, _cb binary"))


def spearman_lanes(
    df: DataFrame, by: Sequence[str], y: str, p: str, weights: Sequence[str] = (), keys: DataFrame | None = None, packed: tuple[str, int, int] | None = None
) -> DataFrame:
    """(by, lane, n, rho): mid-rank correlation of two columns under each weight column; without any, every row counts once.

    Rows with a null key or a value that is not finite are left out; weights are whole numbers. rho is NULL where a
    column does not vary. keys: the different keys of df, if they are known without reading it. df is read once more
    for its keys otherwise, and then written out in blocks. packed: instead of weight columns, the name of a binary column
    with a byte for each lane, how many lanes are worked on at a time, and in how many batches.
    """
    by, lanes, batches = list(by), packed[1] if packed else max(1, len(weights)), packed[2] if packed else 1
    a, b = finite(F.col(y).cast("double")), finite(F.col(p).cast("double"))
    known = (keys if keys is not None else df).select(*by).dropna().distinct()
    numbered = measured(known.withColumn("_k", F.monotonically_increasing_id()))
    named = [F.col(packed[0]).alias("_w")] if packed else [F.col(w).cast("int").alias(f"_w{i}") for i, w in enumerate(weights)]
    weights = bool(named)
    rows = df.select(*by, a.alias("_a"), b.alias("_b"), *named)
    usable = rows.filter(F.col("_a").isNotNull() & F.col("_b").isNotNull()).join(numbered, by)
    # Blocks of many lanes are read row by row: Spark's reader of Parquet files would hold thousands of them at a time.
    blocks = cut_lineage(_blocks(usable, lanes, batches)) if packed else measured(_blocks(usable, lanes if weights else 0))
    cut = blocks.join(_cuts(blocks), "_k")
    names = [f"_s{i}" for i in range(lanes)]
    sums = "_k long, _kind int, _r int, " + ", ".join(f"{s} double" for s in names)

    def weight_of(data: bytes, n: int) -> np.ndarray:
        return _unpacked(data, n, lanes) if weights else np.ones((n, 1), np.int64)

    def summed(where: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ranges that occur and the sums of their rows."""
        if not where.any():
            return where[:1], values.sum(axis=0, keepdims=True)
        order = np.argsort(where, kind="stable")
        ordered = where[order]
        starts = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
        return ordered[starts], np.add.reduceat(values[order], starts, axis=0)

    def rows_of(made: list[tuple[int, int, np.ndarray, np.ndarray]]) -> pd.DataFrame:
        """One table of (key, kind, ranges, sums) of many keys and kinds."""
        key, kind, r, values = zip(*made, strict=True)
        sizes = [len(x) for x in r]
        out = {"_k": np.repeat(key, sizes), "_kind": np.repeat(kind, sizes), "_r": np.concatenate(r)}
        values = np.concatenate(values).astype(float)
        return pd.DataFrame(out | {s: values[:, i] for i, s in enumerate(names)})

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for t in batch.itertuples(index=False, name=None):
                row = dict(zip(batch.columns, t, strict=True))
                w = weight_of(row["w"], row["_n"])
                columns = ((_NA, "a", "_ca"), (_NB, "b", "_cb"))
                yield rows_of([(row["_k"], kind, *summed(_placed(_f8(row[c]), _f8(row[cuts])), w)) for kind, c, cuts in columns])

    counted = cut.mapInPandas(count, sums).groupBy("_k", "_kind", "_r").agg(*[F.sum(s).alias(s) for s in names])
    totals = measured(counted)

    def offset(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("_r")
        own = pdf[names].to_numpy().astype(np.int64)
        upto = np.cumsum(own, axis=0)
        base = 2 * (upto - own) - upto[-1]
        return pd.DataFrame(
            {"_k": pdf["_k"].iloc[:1], "_ranges": [pdf["_r"].to_numpy(np.int32).tobytes()], "_base": [base.tobytes()], "_own": [own.tobytes()]}
        )

    offsets = measured(totals.filter(F.col("_kind") == _NA).groupBy("_k").applyInPandas(offset, "_k long, _ranges binary, _base binary, _own binary"))
    piece = "_k long, _r int, _d int, _n long, base binary, own binary, a binary, rb binary, b binary, w binary"

    def split(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        deal = np.random.default_rng()
        for batch in batches:
            out = []
            for t in batch.itertuples(index=False, name=None):
                row = dict(zip(batch.columns, t, strict=True))
                a, b, n = _f8(row["a"]), _f8(row["b"]), row["_n"]
                ranges = np.frombuffer(row["_ranges"], np.int32)
                base, own = (np.frombuffer(row[c], np.int64).reshape(-1, lanes) for c in ("_base", "_own"))
                ra, rb = _placed(a, _f8(row["_ca"])), _placed(b, _f8(row["_cb"]))
                w = _unpacked(row["w"], n, lanes) if weights else None
                if ra.any():
                    order = np.argsort(ra, kind="stable")
                    a, b, ra, rb, w = a[order], b[order], ra[order], rb[order], w[order] if weights else None
                for i, j in _runs(ra):
                    r = int(ra[i])
                    at = int(np.searchsorted(ranges, r))
                    settled, open_b = r % 2 == 1, rb[i:j] % 2 == 0
                    out.append(
                        (row["_k"], r, int(deal.integers(1, 1 << 30)) if settled else 0, j - i, base[at].tobytes(), own[at].tobytes(),
                         b"" if settled else a[i:j].tobytes(), _packed(rb[i:j]), b[i:j][open_b].tobytes(), _packed(w[i:j]) if weights else b"")
                    )
            yield pd.DataFrame(out, columns=[c.split()[0] for c in piece.split(", ")])

    passed = "_k long, _kind int, _r int, _g int, _n long, b binary, c binary, w binary, " + ", ".join(f"{s} double" for s in names)
    columns = [c.split()[0] for c in passed.split(", ")]

    def gathered(pdf: pd.DataFrame, column: str) -> np.ndarray:
        parts = [_unpacked(x, n, lanes) for x, n in zip(pdf[column], pdf["_n"], strict=True)]
        return np.concatenate(parts)

    def first(pdf: pd.DataFrame) -> pd.DataFrame:
        key, r, sizes = int(pdf["_k"].iloc[0]), int(pdf["_r"].iloc[0]), pdf["_n"].to_numpy()
        n = int(sizes.sum())
        w = gathered(pdf, "w") if weights else np.ones((n, 1), np.int64)
        base, own = (np.frombuffer(pdf[c].iloc[0], np.int64) for c in ("base", "own"))
        rb = np.concatenate([_unpacked(x, m, 1)[:, 0] for x, m in zip(pdf["rb"], sizes, strict=True)])
        unsettled = rb % 2 == 0
        b = np.full(n, np.nan)
        b[unsettled] = _f8(b"".join(pdf["b"]))
        if r % 2:
            c = np.repeat((base + own)[None, :], n, axis=0)
        else:
            a = _f8(b"".join(pdf["a"]))
            order = np.argsort(a, kind="stable")
            rb, unsettled, b, w = rb[order], unsettled[order], b[order], w[order]
            c = _local_ranks(a[order], w)
            c += base
        weighted = (w * c).astype(float)
        table = rows_of([(key, _AA, np.array([-1]), (weighted * c).sum(axis=0, keepdims=True)), (key, _A, *summed(rb, weighted))])
        table["_g"] = -1 - table["_r"] % 8
        if unsettled.any():
            b, where = b[unsettled], rb[unsettled]
            order = np.argsort(where, kind="stable")
            b, where, c, w = b[order], where[order], c[unsettled][order], w[unsettled][order]
            pieces = [
                (key, -1, int(where[i]), int(where[i]), j - i, b[i:j].tobytes(), _packed(c[i:j]), _packed(w[i:j]) if weights else b"") for i, j in _runs(where)
            ]
            table = pd.concat([table, pd.DataFrame(pieces, columns=columns[:8])], ignore_index=True)
        return table.reindex(columns=columns)

    def second(pdf: pd.DataFrame) -> pd.DataFrame:
        if pdf["_kind"].iloc[0] >= 0:
            return pdf[["_k", "_kind", "_r", *names]]
        key, r, n = int(pdf["_k"].iloc[0]), pdf["_r"].to_numpy()[:1], int(pdf["_n"].sum())
        b = _f8(b"".join(pdf["b"]))
        order = np.argsort(b, kind="stable")
        w = gathered(pdf, "w")[order] if weights else np.ones((n, 1), np.int64)
        local = _local_ranks(b[order], w)
        wl = (w * local).astype(float)
        made = ((_AB, wl * gathered(pdf, "c")[order]), (_BB, wl * local), (_B, wl))
        return rows_of([(key, kind, r, x.sum(axis=0, keepdims=True)) for kind, x in made])

    pieces = cut.join(offsets, "_k").mapInPandas(split, piece)
    ranked = pieces.groupBy("_k", "_r", "_d").applyInPandas(first, passed)
    parts = ranked.groupBy("_k", "_g").applyInPandas(second, sums)
    whole = parts.groupBy("_k", "_kind", "_r").agg(*[F.sum(s).alias(s) for s in names]).unionByName(totals)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        kinds, at, values = pdf["_kind"].to_numpy(), pdf["_r"].to_numpy(), np.stack([pdf[s].to_numpy() for s in names], axis=1)
        ranges, order = at[kinds == _NB], np.argsort(at[kinds == _NB])
        ranges, n = ranges[order], values[kinds == _NB][order]
        upto = np.cumsum(n, axis=0)
        base = 2 * (upto - n) - upto[-1]

        def of(kind: int) -> np.ndarray:
            out = np.zeros_like(n)
            out[np.searchsorted(ranges, at[kinds == kind])] = values[kinds == kind]
            return out

        settled = (ranges % 2 == 1)[:, None]
        ab = np.where(settled, of(_A) * (base + n), of(_AB) + base * of(_A)).sum(axis=0)
        bb = np.where(settled, n * (base + n) ** 2, of(_BB) + 2 * base * of(_B) + base * base * n).sum(axis=0)
        aa = values[kinds == _AA].sum(axis=0)
        some = (aa > 0) & (bb > 0)
        rho = np.divide(ab, np.sqrt(aa) * np.sqrt(bb), out=np.zeros(lanes), where=some)
        return pd.DataFrame(
            {"_k": int(pdf["_k"].iloc[0]), "lane": np.arange(lanes, dtype=np.int32), "n": upto[-1].astype(np.int64), "rho": pd.Series(rho).where(some, None)}
        )

    solved = whole.groupBy("_k").applyInPandas(solve, "_k long, lane int, n long, rho double")
    own = measured(solved.select(F.expr(f"_k div {batches}").alias("_k"), (F.col("_k") % batches * lanes + F.col("lane")).cast("int").alias("lane"), "n", "rho"))
    return numbered.join(own, "_k").select(*by, "lane", "n", "rho")


def spearman(df: DataFrame, by: Sequence[str], y: str, p: str, keys: DataFrame | None = None) -> DataFrame:
    """(by, n, rho) of the rows in which both values are finite."""
    return spearman_lanes(df, by, y, p, keys=keys).drop("lane")
