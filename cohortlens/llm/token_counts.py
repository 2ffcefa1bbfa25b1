"""Exact token counts of whole texts; huge texts are encoded in overlapping chunks and spliced where both agree.

A chunk's encoding is right as far as its edges don't reach. Merges follow one order of all pieces, so every piece of an
encoding stays the same wherever its two neighbours are the same: a sequence of pieces is the encoding of its text if
each two neighbours are the encoding of theirs. If two overlapping chunks have one piece in common (same place, same
length), then the pieces of the first chunk before it and those of the second chunk from it on are such a sequence. So
one common piece in an overlap proves the splice; a text whose chunks have none gets longer chunks with wider overlaps,
at last a single one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import partitions, written

#: Code points of a chunk and of an overlap in the first round; both grow by WIDER where an overlap has no common piece.
CHUNK, OVERLAP, WIDER = 32_768, 256, 4
#: Bytes of text encoded in one call.
CALL = 1 << 20
_MODELS: dict = {}


class Model:
    """A sentencepiece model and how many code points of the text each of its pieces stands for.

    The normaliser must keep code points one for one but for a leading blank, as piece_bpe_32k.model does. A code point
    without a piece becomes one piece per byte: the first stands for it, the others for nothing.
    """

    def __init__(self, path: str):
        import sentencepiece

        if "/" not in path:
            import public_tokenizers

            path = public_tokenizers.path(path)
        self.sp = sentencepiece.SentencePieceProcessor(model_file=path)
        self.width = np.array([self._width(i) for i in range(self.sp.get_piece_size())], np.int64)
        if "".join(self.sp.encode("a  b ", out_type=str)) != "▁a▁▁b▁":
            raise ValueError(f"{path} changes more of a text than its first blank")

    def _width(self, i: int) -> int:
        if self.sp.is_byte(i):
            return int(int(self.sp.id_to_piece(i)[3:5], 16) & 0xC0 != 0x80)
        return 1 if self.sp.is_unknown(i) else len(self.sp.id_to_piece(i))

    def counts(self, texts: list[str]) -> list[int]:
        """Numbers of pieces, encoded in calls of bounded size."""
        out, at = [], 0
        while at < len(texts):
            end, held = at, 0
            while end < len(texts) and (end == at or held + len(texts[end]) <= CALL):
                held += len(texts[end])
                end += 1
            out += [len(x) for x in self.sp.encode(texts[at:end], num_threads=1)]
            at = end
        return out

    def places(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """First code point and width of each piece; the blank put before the text is at -1."""
        width = self.width[np.array(self.sp.encode(text, num_threads=1), np.int64)]
        return np.cumsum(width) - width - 1, width


def model(path: str) -> Model:
    """One per worker process and file."""
    if path not in _MODELS:
        _MODELS[path] = Model(path)
    return _MODELS[path]


def _chunks(length: int, size: int) -> range:
    """Where the chunks of a text begin; a rest shorter than half a chunk belongs to the last one."""
    return range(0, max(1, length - size // 2), size)


def _cut(df: DataFrame, size: int, overlap: int) -> DataFrame:
    """(digest, chunk, begin, next, text): chunks with the overlap that reaches into the next one; next is null in the last."""
    schema = pa.schema([("digest", pa.string()), ("chunk", pa.int64()), ("begin", pa.int64()), ("next", pa.int64()), ("text", pa.string())])

    def cut(batches):
        for batch in batches:
            for digest, text in zip(batch.column("digest").to_pylist(), batch.column("text"), strict=True):
                text = text.as_py()
                starts = _chunks(len(text), size)
                for i, begin in enumerate(starts):
                    follows = starts[i + 1] if i + 1 < len(starts) else None
                    part = text[begin:] if follows is None else text[begin : follows + overlap]
                    yield pa.RecordBatch.from_pylist([{"digest": digest, "chunk": i, "begin": begin, "next": follows, "text": part}], schema)

    return df.select("digest", "text").mapInArrow(cut, "digest string, chunk bigint, begin bigint, next bigint, text string")


def _encoded(chunks: DataFrame, path: str, overlap: int) -> DataFrame:
    """Pieces per chunk, and those that lie whole in its first and last `overlap` code points.

    (digest, chunk, n, head_at, head, tail_at, tail): head and tail hold 32 * place + width of consecutive pieces, the
    first being piece number head_at or tail_at of the chunk; bytes that stand for nothing hold negative numbers.
    """
    lists = pa.list_(pa.int64())
    schema = pa.schema([("digest", pa.string()), *[(c, pa.int64()) for c in ("chunk", "n", "head_at")], ("head", lists), ("tail_at", pa.int64()), ("tail", lists)])

    def encode(batches):
        m = model(path)
        for batch in batches:
            rows = []
            for digest, chunk, begin, follows, text in zip(*[batch.column(c) for c in ("digest", "chunk", "begin", "next", "text")], strict=True):
                text, chunk = text.as_py(), chunk.as_py()
                at, width = m.places(text)
                key, none = np.where(width > 0, 32 * (at + begin.as_py()) + width, -1), slice(0, 0)
                head = slice(np.searchsorted(at, 0), np.searchsorted(at + width, overlap, "right")) if chunk else none
                tail = slice(np.searchsorted(at, len(text) - overlap), len(at)) if follows.is_valid else none
                rows.append({
                    "digest": digest.as_py(), "chunk": chunk, "n": len(at), "head_at": head.start, "head": key[head],
                    "tail_at": tail.start, "tail": np.where(key[tail] < 0, -2, key[tail]),
                })
            yield pa.RecordBatch.from_pylist(rows, schema)

    return chunks.mapInArrow(encode, "digest string, chunk bigint, n bigint, head_at bigint, head array<bigint>, tail_at bigint, tail array<bigint>")


def _huge_counts(huge: DataFrame, path: str, size: int, overlap: int) -> DataFrame:
    """(digest, n_tokens) of each distinct text; its chunks are dealt over the tasks, so that one text is no task of its own."""
    done, open_ = None, huge.select("digest", "text")
    while True:
        chunks = _cut(open_, size, overlap).repartition(partitions(huge.sparkSession), "digest", "chunk", F.spark_partition_id())
        # equal texts give equal rows
        parts = written(_encoded(chunks, path, overlap).dropDuplicates(["digest", "chunk"]), "chunks")
        left = parts.filter(F.size("tail") > 0).select("digest", (F.col("chunk") + 1).alias("chunk"), "n", "tail_at", "tail")
        met = left.join(parts.select("digest", "chunk", "head_at", "head"), ["digest", "chunk"])
        met = met.withColumn("common", F.try_element_at(F.array_intersect("tail", "head"), F.lit(1)))
        # what the first chunk has from the common piece on, and the second before it, isn't in the text's encoding
        after = F.col("n") - F.col("tail_at") - F.array_position("tail", F.col("common")) + 1
        before = F.col("head_at") + F.array_position("head", F.col("common")) - 1
        splices = written(met.select("digest", (after + before).alias("surplus")), "splices")
        failed = splices.filter(F.col("surplus").isNull()).select("digest").distinct()
        summed = parts.select("digest", "n").unionByName(splices.select("digest", (-F.col("surplus")).alias("n")))
        fine = summed.groupBy("digest").agg(F.sum("n").alias("n_tokens")).join(failed, "digest", "left_anti")
        done = fine if done is None else done.unionByName(fine)
        if failed.isEmpty():
            return done
        open_, size, overlap = huge.join(failed, "digest", "left_semi").select("digest", "text"), size * WIDER, overlap * WIDER


def count_tokens(
    docs: DataFrame, path: str = "piece_bpe_32k.model", limit: int = 4096, chunk: int = CHUNK, overlap: int = OVERLAP,
    id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """(id_col, n_bytes, n_tokens, over_limit) for every row: UTF-8 bytes and pieces of the whole text.

    A null text is an empty one with 0 of both. Rows may repeat and ids may be null: each row gives one row. Texts of
    up to `chunk` bytes are encoded as they are; longer ones in chunks of `chunk` code points that share `overlap`.
    An empty table gives an empty table; other columns are not read.
    """
    if not 32 <= overlap <= chunk // 2:
        raise ValueError("an overlap has at least 32 code points and at most half a chunk")
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("id"), text.alias("text"), F.octet_length(text).cast("bigint").alias("n_bytes"))
    kind = rows.schema["id"].dataType.simpleString()

    def short(batches):
        m = model(path)
        for batch in batches:
            n = m.counts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("id"), batch.column("n_bytes"), pa.array(n, pa.int64())], names=["id", "n_bytes", "n_tokens"])

    counted = rows.filter(F.col("n_bytes") <= chunk).mapInArrow(short, f"id {kind}, n_bytes bigint, n_tokens bigint")
    huge = rows.filter(F.col("n_bytes") > chunk).withColumn("digest", F.sha2("text", 256))
    spliced = huge.select("id", "n_bytes", "digest").join(_huge_counts(huge, path, chunk, overlap), "digest")
    both = counted.unionByName(spliced.select("id", "n_bytes", "n_tokens"))
    return both.select(F.col("id").alias(id_col), "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))
