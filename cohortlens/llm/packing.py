"""Best-fit packing of token pieces into sequences after a Martello-Toth reduction.

Pieces are no longer than a sequence, so their lengths make a histogram of at most `capacity` rows, whatever the corpus
is. The packing is worked out on the histogram, many equal sequences at a time, and the pieces then take their places
by their rank among the pieces of their length.
"""

from __future__ import annotations

import bisect
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortlens.llm.common import partitions, shared_path, written
from cohortlens.llm.tokens import encoder, forget


class _Plan:
    """Places: pieces `rank` to `rank + count` of a length go to sequences `bin` on, at `offset`."""

    def __init__(self, counts: dict[int, int], capacity: int):
        self.capacity = capacity
        self.left = {k: int(n) for k, n in counts.items() if n}
        self.sizes = sorted(self.left)
        self.rank = dict.fromkeys(self.sizes, 0)
        self.bins = 0
        self.places: list[tuple[int, int, int, int, int]] = []

    def put(self, length: int, count: int, first: int, offset: int) -> None:
        self.places.append((length, self.rank[length], count, first, offset))
        self.rank[length] += count
        self.left[length] -= count
        if not self.left[length]:
            del self.left[length]
            self.sizes.pop(bisect.bisect_left(self.sizes, length))

    def smallest(self, n: int, without: int, above: int = 0) -> list[int]:
        """The n smallest pieces longer than above, one of length without set aside."""
        out, at = [], bisect.bisect_right(self.sizes, above)
        while at < len(self.sizes) and len(out) < n:
            size = self.sizes[at]
            out += [size] * min(n, self.left[size] - (size == without))
            at += 1
        return out[:n]

    def largest(self, room: int, without: list[int]) -> int:
        """The longest piece that fits, those of without set aside; 0 if none does."""
        at = bisect.bisect_right(self.sizes, room) - 1
        while at >= 0 and self.left[self.sizes[at]] <= without.count(self.sizes[at]):
            at -= 1
        return self.sizes[at] if at >= 0 else 0

    def fix(self, group: list[int]) -> None:
        """As many sequences of this group as the pieces suffice for."""
        m = min(self.left[x] // group.count(x) for x in set(group))
        offset = 0
        for x in group:
            self.put(x, m, self.bins, offset)
            offset += x
        self.bins += m

    def dominating(self, j: int) -> list[int] | None:
        """A group with j that is as good as any other group with j: piece by piece at least as long."""
        room = self.capacity - j
        least = self.smallest(3, j)
        if not least or least[0] > room:
            return [j]
        k = self.largest(room, [j])
        if k == room or len(least) < 2 or least[0] + least[1] > room:
            return [j, k]
        if len(least) == 3 and sum(least) <= room:
            return None
        # at most two pieces fit beside j
        b = self.largest(room - k, [j, k])
        if b:
            above = self.smallest(2, j, b)
            return [j, k, b] if len(above) < 2 or sum(above) > room else None
        best = max((x + y for x in self.sizes if (y := self.largest(room - x, [j, x]))), default=0)
        return [j, k] if k >= best else None

    def reduce(self) -> None:
        """Longest first, until no group dominates; what is fixed is never reconsidered."""
        changed = True
        while changed:
            changed = False
            for j in self.sizes[::-1]:
                while j in self.left and (group := self.dominating(j)):
                    self.fix(group)
                    changed = True

    def best_fit(self) -> None:
        """The rest by decreasing length, each into the fullest sequence that has room."""
        open_: dict[int, list[tuple[int, int]]] = {}
        rooms: list[int] = []

        def offer(room: int, first: int, count: int) -> None:
            if room and count:
                if room not in open_:
                    bisect.insort(rooms, room)
                    open_[room] = []
                open_[room].append((first, count))

        for length in self.sizes[::-1]:
            while n := self.left.get(length, 0):
                at = bisect.bisect_left(rooms, length)
                if at < len(rooms):
                    room = rooms[at]
                    first, count = open_[room].pop()
                    if not open_[room]:
                        del open_[room]
                        rooms.pop(at)
                else:
                    room, first, count = self.capacity, self.bins, -(-n // (self.capacity // length))
                    self.bins += count
                each = room // length
                full = min(count, n // each)
                for i in range(each):
                    if full:
                        self.put(length, full, first, self.capacity - room + i * length)
                offer(room - each * length, first, full)
                rest = min(n - full * each, each - 1) if full < count else 0
                for i in range(rest):
                    self.put(length, 1, first + full, self.capacity - room + i * length)
                used = full + (rest > 0)
                if rest:
                    offer(room - rest * length, first + full, 1)
                offer(room, first + used, count - used)


def plan(counts: dict[int, int], capacity: int) -> tuple[np.ndarray, int]:
    """Places (length, rank, count, bin, offset), sorted, and the number of sequences."""
    p = _Plan(counts, capacity)
    p.reduce()
    p.best_fit()
    return np.array(sorted(p.places), np.int64).reshape(-1, 5), p.bins


def token_pieces(docs: DataFrame, vocab: str, end_id: int, capacity: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, length, part, order, ids): each text's ids and end_id, cut every `capacity` ids, in bytes of 2 or 4 an id.

    Whole texts; a null text is an empty one and makes one piece of end_id alone, null ids and repeated rows make
    pieces like all others. Only texts of more than capacity ids are cut, and only their last piece may be shorter than
    capacity. part is the task, order the number of the piece among those of its length in the task.
    """
    fields = [("doc_id", pa.int64()), ("piece", pa.int32()), ("length", pa.int64()), ("part", pa.int32()), ("order", pa.int64()), ("ids", pa.binary())]
    schema = pa.schema(fields)

    def batch_of(rows):
        columns = list(zip(*rows, strict=True)) if rows else [()] * len(schema)
        return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, schema, strict=True)], schema=schema)

    def pieces(batches):
        enc, part, seen = encoder(vocab), TaskContext.get().partitionId(), Counter()
        end, width = np.array([end_id], enc.dtype).tobytes(), enc.dtype.itemsize
        for batch in batches:
            rows, held = [], 0
            for key, text in zip(batch.column("id").to_pylist(), batch.column("text"), strict=True):
                ids = enc.encode(text.as_py()) + end
                for number, start in enumerate(range(0, len(ids), capacity * width)):
                    own = ids[start : start + capacity * width]
                    length = len(own) // width
                    rows.append((key, number, length, part, seen[length], own))
                    seen[length] += 1
                held += len(ids)
                if held > 1 << 23:
                    yield batch_of(rows)
                    rows, held = [], 0
            yield batch_of(rows)

    rows = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.col(f"`{text_col}`").alias("text"))
    return rows.mapInArrow(pieces, "doc_id bigint, piece int, length bigint, part int, order bigint, ids binary")


def pack_pieces(pieces: DataFrame, capacity: int) -> DataFrame:
    """(sequence_id, offset, length, doc_id, piece, ids) of the pieces of token_pieces; an empty table gives an empty one.

    A piece's rank among its length is its order in its task and the number of such pieces in earlier tasks. The pieces
    are stored in buckets by task, so that these numbers, one row per task, meet them where they lie: no ids are
    shuffled here. The places are at most a few per length and are sent to the tasks.
    """
    spark = pieces.sparkSession
    path = shared_path(spark, "pieces")
    name = path.rsplit("/", 1)[-1].replace("-", "_")
    pieces.write.bucketBy(partitions(spark), "part").option("path", path).option("compression", "zstd").saveAsTable(name)
    stored = spark.table(name)
    sums = written(stored.groupBy("part", "length").agg(F.count(F.lit(1)).alias("n")), "lengths")
    counts = {r.length: r.n for r in sums.groupBy("length").agg(F.sum("n").alias("n")).collect()}
    places, _ = plan(counts, capacity)
    keys, table = places[:, 0] << 44 | places[:, 1], places

    earlier = sums.select("part", "length", (F.sum("n").over(W.partitionBy("length").orderBy("part")) - F.col("n")).alias("n"))
    earlier = earlier.groupBy("part").agg(F.map_from_entries(F.collect_list(F.struct("length", "n"))).alias("earlier"))
    rank = F.element_at("earlier", F.col("length")) + F.col("order")
    ranked = stored.join(earlier.hint("shuffle_hash"), "part").select("doc_id", "piece", "length", "ids", rank.alias("rank"))

    def place(batches):
        forget()
        for batch in batches:
            rank, length = (batch.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in ("rank", "length"))
            at = np.searchsorted(keys, length << 44 | rank, "right") - 1
            found = [pa.array(table[at, 3] + rank - table[at, 1]), pa.array(table[at, 4])]
            names = ["length", "doc_id", "piece", "ids"]
            yield pa.RecordBatch.from_arrays([*found, *[batch.column(c) for c in names]], names=["sequence_id", "offset", *names])

    return ranked.mapInArrow(place, "sequence_id bigint, offset bigint, length bigint, doc_id bigint, piece int, ids binary")


def _sequences(rows: pa.Table, capacity: int) -> pa.RecordBatch:
    """Whole sequences, rows ordered by sequence_id and offset; pieces that leave a gap or overlap are an error."""
    seq, offset, length = (rows[c].to_numpy() for c in ("sequence_id", "offset", "length"))
    first, ends = np.flatnonzero(np.diff(seq, prepend=-1)), np.cumsum(length)
    begin = (ends - length)[first]
    ids = b"".join(rows["ids"].to_pylist())
    total = int(ends[-1])
    values = np.frombuffer(ids, "<u2" if len(ids) == 2 * total else "<u4")
    if len(values) != total or (offset != ends - length - np.repeat(begin, np.diff(first, append=len(seq)))).any():
        raise ValueError("pieces do not fill their sequences without gaps")
    sizes = np.diff(begin, append=total)
    if sizes.max() > capacity:
        raise ValueError("a sequence is longer than its capacity")
    by_piece = pa.array(np.append(first, len(seq)), pa.int32())
    listed = [pa.ListArray.from_arrays(by_piece, rows[c].combine_chunks().cast(t)) for c, t in (("doc_id", pa.int64()), ("piece", pa.int32()), ("length", pa.int32()))]
    ends = (np.append(begin, total) * values.dtype.itemsize).astype(np.int32)
    tokens = pa.Array.from_buffers(pa.binary(), len(first), [None, pa.py_buffer(ends), pa.py_buffer(ids)])
    return pa.RecordBatch.from_arrays([pa.array(seq[first]), tokens, *listed], names=["sequence_id", "ids", "doc_ids", "pieces", "lengths"])


def pack_sequences(docs: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096, **columns) -> DataFrame:
    """(sequence_id, ids, doc_ids, pieces, lengths): the packed sequences, read from the shared folder.

    ids are the bytes, 2 or 4 each, of at most `capacity` token ids: those of the sequence's pieces one after the other;
    doc_ids, pieces (a piece's number in its document) and lengths tell them apart. Ids are bytes from the encoder on,
    so that Spark never handles them one by one.
    """
    rows = pack_pieces(token_pieces(docs, vocab, end_id, capacity, **columns), capacity)

    def build(batches):
        forget()
        held = None  # the last sequence, which may go on in the next batch
        for batch in batches:
            if not batch.num_rows:
                continue
            new = pa.Table.from_batches([batch])
            table = new if held is None else pa.concat_tables([held, new])
            seq = table["sequence_id"].to_numpy()
            starts = np.flatnonzero(np.diff(seq, prepend=-1))
            cuts = [*starts[:-1:256], starts[-1]] if len(starts) > 1 else [0]
            for i, j in zip(cuts, cuts[1:], strict=False):
                yield _sequences(table.slice(i, j - i), capacity)
            held = table.slice(starts[-1]).combine_chunks()
        if held is not None:
            yield _sequences(held, capacity)

    grouped = rows.repartition("sequence_id").sortWithinPartitions("sequence_id", "offset")
    schema = "sequence_id bigint, ids binary, doc_ids array<bigint>, pieces array<int>, lengths array<int>"
    return written(grouped.mapInArrow(build, schema), "sequences", "zstd")


def pack_documents(docs: DataFrame, vocab: str = "word_bpe_49k.json", end_id: int = 1, capacity: int = 4096, **columns) -> DataFrame:
    """pack_sequences with the ids of a sequence as a list of numbers."""

    def listed(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                values, tokens = _token_values(part)
                ids = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(tokens)), pa.int32()), pa.array(values.astype(np.int32)))
                yield pa.RecordBatch.from_arrays([ids if c == "ids" else part.column(c) for c in names], names=names)

    names = ["sequence_id", "ids", "doc_ids", "pieces", "lengths"]
    packed = pack_sequences(docs, vocab, end_id, capacity, **columns)
    return packed.mapInArrow(listed, "sequence_id bigint, ids array<int>, doc_ids array<bigint>, pieces array<int>, lengths array<int>")


def _token_values(sequences: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray]:
    """All ids of some sequences, stored as bytes or listed, and the number of each sequence's."""
    per = np.array([len(x) for x in sequences.column("lengths")], np.int64)
    tokens = np.add.reduceat(np.append(sequences.column("lengths").flatten().to_numpy().astype(np.int64), 0), np.cumsum(per) - per)
    if not pa.types.is_binary(sequences.schema.field("ids").type):
        return sequences.column("ids").flatten().to_numpy(), tokens
    data = b"".join(sequences.column("ids").to_pylist())
    return np.frombuffer(data, "<u2" if len(data) == 2 * tokens.sum() else "<u4"), tokens


def piece_digests(sequences: DataFrame, capacity: int = 4096) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of the pieces as they lie in the sequences of either form."""

    def digests(batches):
        forget()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                docs, pieces, lengths = (part.column(c).flatten() for c in ("doc_ids", "pieces", "lengths"))
                values, tokens = _token_values(part)
                data = memoryview(values.astype("<u4").tobytes())
                n, number = lengths.to_numpy().astype(np.int64), pieces.to_numpy().astype(np.int64)
                per = np.array([len(x) for x in part.column("lengths")], np.int64)
                begin = np.cumsum(n) - n
                whose = np.repeat(np.arange(len(per)), per)
                offset = begin - (np.cumsum(tokens) - tokens)[whose]
                crc = [zlib.crc32(data[4 * b : 4 * (b + k)]) for b, k in zip(begin.tolist(), n.tolist(), strict=True)]
                out = [docs, pieces, number * capacity, n, np.array(crc, np.int64), part.column("sequence_id").to_numpy()[whose], offset]
                yield pa.RecordBatch.from_arrays([pa.array(x) if isinstance(x, np.ndarray) else x for x in out], names=names)

    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    return sequences.mapInArrow(digests, "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
