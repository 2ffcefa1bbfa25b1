"""Token ids in files of fixed-width bits.

A file is a row of segments. A segment is a head (magic, bits per id, documents, ids, blocks, bytes of the payload),
the documents' ids and lengths, the blocks' offsets in the payload, and the payload: blocks of 65,536 ids, each id in
the fewest bits that hold the vocabulary. Any id is found by its number: block = i // 65536, bit = i % 65536 * width.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortlens.llm.common import partitions, shared_path, written
from cohortlens.llm.tokens import encoder

MAGIC, BLOCK = 0x3142444954, 65_536
#: A segment is closed when it has so many ids, a file when it has so many segments.
SEGMENT, SEGMENTS = 1 << 22, 8
_NULL = np.iinfo(np.int64).min


def width_of(vocab_size: int) -> int:
    return max(1, int(vocab_size - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """64 ids make width 64-bit words; one vector operation per place among the 64."""
    n = -len(ids) % 64
    rows = np.concatenate([np.asarray(ids, np.uint64), np.zeros(n, np.uint64)]).reshape(-1, 64)
    out = np.zeros((len(rows), width), np.uint64)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        out[:, word] |= rows[:, j] << np.uint64(shift)
        if shift + width > 64:
            out[:, word + 1] |= rows[:, j] >> np.uint64(64 - shift)
    return out.astype("<u8").tobytes()


def unpack(data, n: int, width: int, start: int = 0) -> np.ndarray:
    """Ids start to start + n of a packed block, as uint32."""
    first, last = start // 64, (start + n + 63) // 64
    rows = np.frombuffer(data, "<u8", (last - first) * width, first * width * 8).reshape(-1, width)
    out, mask = np.empty((len(rows), 64), np.uint32), np.uint64((1 << width) - 1)
    for j in range(64):
        word, shift = divmod(j * width, 64)
        x = rows[:, word] >> np.uint64(shift)
        if shift + width > 64:
            x = x | rows[:, word + 1] << np.uint64(64 - shift)
        out[:, j] = x & mask
    return out.reshape(-1)[start - first * 64 : start - first * 64 + n]


def segment(doc_ids: list, lengths: list[int], ids: np.ndarray, width: int) -> bytes:
    blocks = [pack(ids[i : i + BLOCK], width) for i in range(0, len(ids), BLOCK)]
    offsets = np.cumsum([0, *map(len, blocks)])[:-1] if blocks else []
    payload = b"".join(blocks)
    head = np.array([MAGIC, width, len(doc_ids), len(ids), len(blocks), len(payload)], "<i8")
    keys = np.array([_NULL if d is None else d for d in doc_ids], "<i8")
    return b"".join([head.tobytes(), keys.tobytes(), np.array(lengths, "<i8").tobytes(), np.array(offsets, "<i8").tobytes(), payload])


class Segment:
    """Reads a segment at a place in a file; ids(i, n) fetches any run of ids through the block offsets."""

    def __init__(self, data: memoryview, at: int = 0):
        magic, self.width, docs, self.n, blocks, payload = (int(x) for x in np.frombuffer(data, "<i8", 6, at))
        if magic != MAGIC:
            raise ValueError("not a segment")
        at += 48
        self.doc_ids = np.frombuffer(data, "<i8", docs, at)
        self.lengths = np.frombuffer(data, "<i8", docs, at + 8 * docs)
        self.offsets = np.frombuffer(data, "<i8", blocks, at + 16 * docs)
        self._base = at + 16 * docs + 8 * blocks
        self._data, self.end = data, self._base + payload

    def ids(self, start: int, n: int) -> np.ndarray:
        parts = []
        while n > 0:
            block, inside = divmod(start, BLOCK)
            m = min(n, BLOCK - inside)
            parts.append(unpack(self._data[self._base + int(self.offsets[block]) :], m, self.width, inside))
            start, n = start + m, n - m
        return np.concatenate(parts) if parts else np.empty(0, np.uint32)


def segments(data: bytes) -> Iterator[Segment]:
    view, at = memoryview(data), 0
    while at < len(view):
        s = Segment(view, at)
        yield s
        at = s.end + 1


def write_ids(docs: DataFrame, vocab: str, end_id: int, id_col: str = "doc_id", text_col: str = "text") -> str:
    """Writes the ids of all texts, end_id after each, in ascending id_col order; returns the folder.

    Texts are dealt out by id range and sorted; a task then encodes and packs a stream of rows, one segment in memory
    at a time. A null text is empty, null ids come first, equal ids in order of their texts, other columns are not
    read, an empty table gives files without segments. A text is never split over segments.
    """
    spark = docs.sparkSession
    path = shared_path(spark, "ids")

    def blocks(batches):
        enc = encoder(vocab)
        width, end = width_of(enc.size), np.array([end_id], enc.dtype).tobytes()
        keys, lengths, parts, n = [], [], [], 0
        for batch in batches:
            for key, text in zip(batch["id"].array, batch["text"].array, strict=True):
                data = enc.encode(None if pd.isna(text) else text) + end
                keys.append(None if pd.isna(key) else int(key))
                lengths.append(len(data) // enc.dtype.itemsize)
                parts.append(data)
                n += lengths[-1]
                if n >= SEGMENT:
                    yield pd.DataFrame({"value": [segment(keys, lengths, np.frombuffer(b"".join(parts), enc.dtype), width)]})
                    keys, lengths, parts, n = [], [], [], 0
        if keys:
            yield pd.DataFrame({"value": [segment(keys, lengths, np.frombuffer(b"".join(parts), enc.dtype), width)]})

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    ordered = rows.repartitionByRange(partitions(spark), "id").sortWithinPartitions("id", "text")
    packed = ordered.mapInPandas(blocks, "value binary").select(F.col("value").cast("string").alias("value"))
    packed.write.option("lineSep", "\n").option("maxRecordsPerFile", SEGMENTS).text(path)
    return path


def read_ids(spark, path: str) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files of a folder."""

    def documents(batches):
        for batch in batches:
            for part, content in zip(batch["part"], batch["content"], strict=True):
                for number, s in enumerate(segments(content)):
                    starts = np.cumsum(s.lengths) - s.lengths
                    ids = memoryview(s.ids(0, s.n).astype("<u4", copy=False).tobytes())
                    crc = [zlib.crc32(ids[4 * i : 4 * (i + n)]) for i, n in zip(starts.tolist(), s.lengths.tolist(), strict=True)]
                    keys = pd.array(s.doc_ids, dtype="Int64")
                    keys[s.doc_ids == _NULL] = pd.NA
                    yield pd.DataFrame({"doc_id": keys, "part": part, "seg": number, "local": starts, "n_tokens": s.lengths, "ids_crc32": crc})

    # numbers of the writing task and of its file: the order of the ids
    name = F.regexp_extract("path", r"part-(\d+)-[^/]*?(?:-c(\d+))?\.[^/-]*$", 1).cast("bigint")
    file = F.coalesce(F.regexp_extract("path", r"-c(\d+)\.[^/-]*$", 1).try_cast("bigint"), F.lit(0))
    files = spark.read.format("binaryFile").load(path).select((name * 1_000_000 + file).alias("part"), "content")
    found = files.mapInPandas(documents, "doc_id bigint, part bigint, seg bigint, local bigint, n_tokens bigint, ids_crc32 bigint")
    found = written(found, "read")
    totals = found.groupBy("part", "seg").agg(F.sum("n_tokens").alias("n"))
    before = totals.select("part", "seg", (F.sum("n").over(W.orderBy("part", "seg")) - F.col("n")).alias("before"))
    return found.join(before, ["part", "seg"]).select("doc_id", (F.col("before") + F.col("local")).alias("start"), "n_tokens", "ids_crc32")
