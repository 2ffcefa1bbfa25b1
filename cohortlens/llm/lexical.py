"""Ranked lexical search: short lists are summed into accumulators, long lists are read document at a time with skipping.

Documents are indexed in segments, each one row: its documents in ascending order of their ids, and the inverted lists of
the terms that the queries ask for. In a segment a query's short lists are added up term at a time. The sums, with their
largest value as bound, are then one iterator among those of the long lists: while the bounds of the lowest iterators
together can't lift a document above the k-th score so far, only the others propose documents, and the lowest are
probed by binary search for those that still can reach it.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortlens.llm.common import partitions, written

#: A segment is closed at so many documents or postings; the next document may still be of any length.
DOCS, POSTINGS = 32_768, 1 << 20
#: A list is short if it holds at most one in SHORT of the segment's documents. Documents looked at between two updates of the threshold.
SHORT, STEP = 32, 2048
#: Terms of the queries that are answered in one pass over the documents, on average: bounds what is sent to the tasks.
TERMS = 1 << 18

#: Term signs: ASCII digits and letters, A-Z lower-cased, and all bytes of other code points.
_SIGNS = bytes(b + 32 if 0x41 <= b <= 0x5A else b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))


def terms_of(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, with repeats."""
    return text.translate(_SIGNS).split()


_INDEX = "doc_ids array<bigint>, n array<bigint>, terms array<int>, sizes array<int>, at array<int>, tf array<int>"


class _Segment:
    def __init__(self):
        self.ids, self.n, self.terms, self.docs, self.tf = [], [], [], [], []

    def add(self, doc_id, n: int, counts: list[tuple[int, int]]) -> None:
        self.terms += [t for t, _ in counts]
        self.tf += [c for _, c in counts]
        self.docs += [len(self.ids)] * len(counts)
        self.ids.append(doc_id)
        self.n.append(n)

    def full(self) -> bool:
        return len(self.ids) >= DOCS or len(self.terms) >= POSTINGS

    def batch(self) -> pa.RecordBatch:
        ids = pa.array(self.ids, pa.int64())
        order = np.lexsort((ids.fill_null(0).to_numpy(zero_copy_only=False), np.array([x is None for x in self.ids])))
        place = np.argsort(order)
        terms, docs = np.array(self.terms, np.int32), place[np.array(self.docs, np.int64)]
        by_list = np.lexsort((docs, terms))
        names, sizes = np.unique(terms, return_counts=True)
        columns = [ids.take(pa.array(order)), np.array(self.n, np.int64)[order], names, sizes.astype(np.int32), docs[by_list].astype(np.int32), np.array(self.tf, np.int32)[by_list]]
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 4]
        lists = [pa.ListArray.from_arrays(pa.array([0, len(c)], pa.int32()), c if isinstance(c, pa.Array) else pa.array(c, k)) for c, k in zip(columns, kinds, strict=True)]
        return pa.RecordBatch.from_arrays(lists, names=["doc_ids", "n", "terms", "sizes", "at", "tf"])


def index(docs: DataFrame, vocabulary) -> DataFrame:
    """One row per segment of docs (id, text): documents with at least one term, and the lists of the broadcast vocabulary (term to number)."""

    def build(batches):
        numbers, segment = vocabulary.value, _Segment()
        for batch in batches:
            for doc_id, text in zip(batch.column("id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                found = terms_of(text.as_py() or b"")
                if found:
                    counts = Counter(found)
                    segment.add(doc_id, len(found), [(numbers[t], counts[t]) for t in counts.keys() & numbers.keys()])
                    if segment.full():
                        yield segment.batch()
                        segment = _Segment()
        if segment.ids:
            yield segment.batch()

    return docs.select("id", "text").mapInArrow(build, _INDEX)


class Lists:
    """The inverted lists of one segment: documents ascending, impacts, and the largest impact of each list."""

    def __init__(self, row: dict, total_docs: int, total_terms: int):
        n = np.asarray(row["n"], np.int64)
        m = 50 + (50 * n * total_docs) // total_terms
        at, tf = np.asarray(row["at"], np.int64), np.asarray(row["tf"], np.int64)
        self.docs, self.count = at, len(n)
        self.impact = (1_000_000_000 * tf) // (1000 * tf + 20 * m[at])
        self.ends = np.cumsum(row["sizes"])
        self.starts = self.ends - np.asarray(row["sizes"])
        self.place = {t: i for i, t in enumerate(np.asarray(row["terms"]).tolist())}
        self.most = np.maximum.reduceat(self.impact, self.starts) if len(self.starts) else self.impact

    def of(self, terms, weights) -> list[tuple[np.ndarray, np.ndarray, int]]:
        """(documents, scores, bound) of the query's lists, shortest first."""
        found = [(self.place[t], w) for t, w in zip(terms, weights, strict=True) if w and t in self.place]
        found.sort(key=lambda x: self.ends[x[0]] - self.starts[x[0]])
        return [(self.docs[a:b], self.impact[a:b] * w, int(self.most[i]) * w) for i, w in found for a, b in [(self.starts[i], self.ends[i])]]


def best(lists: list[tuple[np.ndarray, np.ndarray, int]], count: int, k: int, above: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(documents, scores) of the k highest sums above `above`, ties to the smaller document; lists from Lists.of."""
    top, scores = np.empty(0, np.int64), np.empty(0, np.int64)
    cut = sum(len(d) * SHORT <= count for d, _, _ in lists)
    iterators = lists[cut:]
    if cut:
        sums = np.zeros(count, np.int64)
        for docs, values, _ in lists[:cut]:
            sums[docs] += values
        held = np.flatnonzero(sums)
        if len(held):
            iterators.append((held, sums[held], int(sums.max())))
    iterators.sort(key=lambda x: x[2])
    reach = np.cumsum([b for _, _, b in iterators])
    edges = [np.searchsorted(d, np.arange(0, count + STEP, STEP)) for d, _, _ in iterators]
    for step in range(-(-count // STEP)):
        idle = int(np.searchsorted(reach, above, "right"))  # these together can't pass the threshold
        if idle == len(iterators):
            break
        low = step * STEP
        part, seen = np.zeros(STEP, np.int64), np.zeros(STEP, bool)
        for (docs, values, _), e in zip(iterators[idle:], edges[idle:], strict=True):
            at = docs[e[step] : e[step + 1]] - low
            part[at] += values[e[step] : e[step + 1]]
            seen[at] = True
        docs = np.flatnonzero(seen)
        part = part[docs]
        for i in range(idle - 1, -1, -1):
            alive = part + reach[i] > above
            docs, part = docs[alive], part[alive]
            listed, values, _ = iterators[i]
            at = np.searchsorted(listed[edges[i][step] : edges[i][step + 1]], docs + low) + edges[i][step]
            there = at < edges[i][step + 1]
            there[there] = listed[at[there]] == docs[there] + low
            part[there] += values[at[there]]
        fine = part > above
        if fine.any():
            top, scores = np.append(top, docs[fine] + low), np.append(scores, part[fine])
            order = np.lexsort((top, -scores))[:k]
            top, scores = top[order], scores[order]
            if len(top) == k:
                above = max(above, int(scores[-1]))
    return top, scores


def _search(indexed: DataFrame, plan, k: int) -> DataFrame:
    """(query, doc_id, score): the best of each task. plan: the broadcast totals and the terms with their weights of each query."""
    schema = pa.schema([("query", pa.int64()), ("doc_id", pa.int64()), ("score", pa.int64())])

    def search(batches):
        total_docs, total_terms, queries = plan.value
        state: dict[int, tuple[list, np.ndarray]] = {}
        for batch in batches:
            for i in range(batch.num_rows):
                row = {c: batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("n", "terms", "sizes", "at", "tf")}
                ids, lists = batch.column("doc_ids")[i].values, Lists(row, total_docs, total_terms)
                for query, (terms, weights) in queries.items():
                    old_ids, old = state.get(query, ([], np.empty(0, np.int64)))
                    # a document of this segment may have the k-th score too, and a smaller id
                    docs, scores = best(lists.of(terms, weights), lists.count, k, int(old[-1]) - 1 if len(old) == k else 0)
                    if len(docs):
                        both, names = np.append(old, scores), old_ids + ids.take(pa.array(docs)).to_pylist()
                        order = sorted(range(len(both)), key=lambda j: (-both[j], names[j] is None, names[j] or 0))[:k]
                        state[query] = [names[j] for j in order], both[order]
        for query, (names, scores) in state.items():
            yield pa.RecordBatch.from_arrays([pa.array([query] * len(names), pa.int64()), pa.array(names, pa.int64()), pa.array(scores)], schema=schema)

    return indexed.mapInArrow(search, "query bigint, doc_id bigint, score bigint")


def _queries(items: DataFrame, item_col: str, text_col: str) -> DataFrame:
    """(number, id, terms): each distinct row with its distinct terms; numbers need not follow one another."""
    rows = items.select(F.col(f"`{item_col}`").alias("id"), F.col(f"`{text_col}`").alias("text")).distinct()
    kind = rows.schema["id"].dataType.simpleString()

    def split(batches):
        for batch in batches:
            found = [sorted(set(terms_of(t.as_py() or b""))) for t in batch.column("text").cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found, pa.list_(pa.binary()))], names=["id", "terms"])

    split_rows = rows.mapInArrow(split, f"id {kind}, terms array<binary>").filter(F.size("terms") > 0)
    return written(split_rows.withColumn("number", F.monotonically_increasing_id()), "queries")


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, doc_col: str = "doc_id", doc_text: str = "text", item_col: str = "item_id", item_text: str = "text",
) -> DataFrame:
    """(item_col, rank, doc_col, score): the k documents with the highest scores above 0 for each item; fewer if there are fewer.

    A score sums w * ((10^9 tf) div (1000 tf + 20 m)) over the item's distinct terms, with w = floor(1000 ln((2N + 2) /
    (2 df + 1))) and m = 50 + (50 n N) div L; all counts over all documents. Ties go to the smaller id, null ids last.
    Null texts and texts without terms have no score; repeated rows of docs are documents each for itself, equal rows
    of items are one item. No documents or items: an empty table. Other columns are not read.

    Items are answered in blocks of bounded size; each block is one pass over docs, and its index is written in segments
    that no shuffle touches. A task sends on k documents an item.
    """
    spark = docs.sparkSession
    rows = docs.select(F.col(f"`{doc_col}`").cast("bigint").alias("id"), F.col(f"`{doc_text}`").alias("text"))
    queries = _queries(items, item_col, item_text)
    asked = queries.agg(F.sum(F.size("terms"))).first()[0] or 0
    blocks = max(1, -(-asked // TERMS))
    found = None
    for block in range(blocks):
        own = queries.filter(F.pmod(F.xxhash64("number"), F.lit(blocks)) == block).select("number", "terms").collect()
        names = sorted({bytes(t) for q in own for t in q.terms})
        numbers = {t: i for i, t in enumerate(names)}
        indexed = written(index(rows, spark.sparkContext.broadcast(numbers)), "index")
        total = indexed.agg(F.sum(F.size("n")), F.sum(F.aggregate("n", F.lit(0).cast("bigint"), lambda s, x: s + x))).first()
        lists = indexed.select(F.explode(F.arrays_zip("terms", "sizes")).alias("x")).groupBy("x.terms").agg(F.sum("x.sizes").alias("df"))
        df = np.zeros(len(names), np.int64)
        for r in lists.collect():
            df[r.terms] = r.df
        weight = np.floor(1000 * np.log((2.0 * (total[0] or 0) + 2) / (2.0 * df + 1))).astype(np.int64).tolist()
        terms = {q.number: [numbers[bytes(t)] for t in q.terms] for q in own}
        plan = total[0], total[1], {q: (t, [weight[x] for x in t]) for q, t in terms.items()}
        part = _search(indexed, spark.sparkContext.broadcast(plan), k)
        found = part if found is None else found.unionByName(part)
    order = [F.desc("score"), F.asc_nulls_last("doc_id")]
    few = found.withColumn("slice", F.pmod(F.xxhash64("doc_id"), F.lit(partitions(spark))))
    few = few.withColumn("rank", F.row_number().over(W.partitionBy("query", "slice").orderBy(*order))).filter(F.col("rank") <= k)
    ranked = few.withColumn("rank", F.row_number().over(W.partitionBy("query").orderBy(*order))).filter(F.col("rank") <= k)
    named = ranked.join(queries.select(F.col("number").alias("query"), "id"), "query")
    return named.select(F.col("id").alias(item_col), "rank", F.col("doc_id").alias(doc_col), "score")
