"""N-gram Jaccard join by T-occurrence search with DivideSkip.

A text's set needs an overlap of at least T with any partner. Its shingles' inverted lists are divided: the short ones,
all but the T - t longest, are merged (grouped by shingle and counted per pair), and a partner must occur at least t
times among them. A partner that is no smaller asks for a larger T, so the smaller of two texts enters still fewer
lists: those are marked as its own. What remains is decided by probing the long lists, a binary search of each shingle
in the partner. Lists that many texts have among their own ones hold changed copies of one text; there the same
search runs once more, over the lists of what each copy changed.
Exact: the division only needs one order of all shingles that every set uses; how well it tells short lists from long
ones (counts in 2^20 cells over all texts) only decides the speed.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortlens.llm.common import partitions, written
from cohortlens.llm.graph import components
from cohortlens.llm.shingles import in_parts, shingle_hashes, shingle_sets

CELL_BITS, CHUNK = 20, 1 << 16
#: Pairs that one task decides, on average.
PAIRS = 2000
#: Shingles of both sides of the pairs that one task compares for their differences, on average.
SET_SIZES = 1 << 21
#: Lists that more texts have among their own ones are worked through by differences from a centre.
MANY = 32
#: Stars are repeated while a round finds more than one link for so many known ones.
FEW = 4


def _least_shared(n):
    """t for a set of n shingles."""
    return n // 32 + 1


def list_lengths(docs: DataFrame, k: int) -> np.ndarray:
    """A level (8-bit logarithm) of the number of shingles in each of 2^20 cells, over all texts."""

    def count(batches):
        total = np.zeros(1 << CELL_BITS, np.int64)
        for batch in batches:
            texts = batch["text"].tolist()
            for a, b in in_parts(texts):
                hashes, _ = shingle_hashes(texts[a:b], k)
                total += np.bincount((hashes >> np.uint64(64 - CELL_BITS)).astype(np.int64), minlength=1 << CELL_BITS)
        if total.any():
            yield pd.DataFrame({"chunk": range(0, len(total), CHUNK), "n": [total[i : i + CHUNK].astype("<i8").tobytes() for i in range(0, len(total), CHUNK)]})

    def add(batches):
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for chunk, n in zip(batch["chunk"], batch["n"], strict=True):
                x = np.frombuffer(n, "<i8")
                sums[chunk] = sums[chunk] + x if chunk in sums else x
        levels = {c: np.minimum(255, np.rint(6 * np.log2(1 + x))).astype(np.uint8).tobytes() for c, x in sums.items()}
        if levels:
            yield pd.DataFrame({"chunk": list(levels), "level": list(levels.values())})

    cells = docs.select("text").mapInPandas(count, "chunk int, n binary").repartition((1 << CELL_BITS) // CHUNK, "chunk")
    out = np.zeros(1 << CELL_BITS, np.uint8)
    for row in cells.mapInPandas(add, "chunk int, level binary").collect():
        out[row.chunk : row.chunk + CHUNK] = np.frombuffer(row.level, np.uint8)
    return out


def signatures(docs: DataFrame, k: int, share: int) -> DataFrame:
    """(id, n, h1, h2, short, own): size and digest of each text's set, and its shingles with the short lists, own ones first."""
    levels = docs.sparkSession.sparkContext.broadcast(list_lengths(docs, k))  # 1 MB for any corpus
    schema = pa.schema([("id", pa.int64()), ("n", pa.int64()), ("h1", pa.int64()), ("h2", pa.int64()), ("short", pa.list_(pa.int64())), ("own", pa.int64())])

    def sign(batches):
        level = levels.value
        for batch in batches:
            texts, ids = batch.column("text").to_pylist(), batch.column("id")
            for a, b in in_parts(texts):
                sizes, h1, h2, short, own = [], [], [], [], []
                for s in shingle_sets(texts[a:b], k):
                    n = len(s)
                    order = level[(s >> np.uint64(64 - CELL_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56) | s >> np.uint64(8)
                    m = min(n, n - -(-share * n // 100) + _least_shared(n))
                    first = min(n, n - -(-2 * share * n // (100 + share)) + _least_shared(n))
                    sizes.append(n)
                    h1.append(s.sum(dtype=np.uint64))
                    h2.append(np.bitwise_xor.reduce(s * (s >> np.uint64(7) | np.uint64(1))) if n else np.uint64(0))
                    own.append(first)
                    short.append((np.partition(order, sorted({first - 1, m - 1}))[:m] if n else order).view(np.int64))
                ends = np.concatenate([[0], np.cumsum([len(x) for x in short])]).astype(np.int32)
                values = pa.array(np.concatenate(short) if short else np.empty(0, np.int64))
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(a, b - a), pa.array(sizes, pa.int64()), *[pa.array(np.array(h, np.uint64).view(np.int64)) for h in (h1, h2)], pa.ListArray.from_arrays(pa.array(ends), values), pa.array(own, pa.int64())],
                    schema=schema,
                )

    return docs.select("id", "text").mapInArrow(sign, "id bigint, n bigint, h1 bigint, h2 bigint, short array<bigint>, own bigint")


def _alike(a: str, b: str, share: int) -> Column:
    return 100 * F.least(a, b) >= share * F.greatest(a, b)


def _enough(pairs: DataFrame) -> DataFrame:
    """Pairs that share at least t of the short lists."""
    counted = pairs.groupBy("a", "b").agg(F.count(F.lit(1)).alias("shared"), F.min("na").alias("na"), F.min("nb").alias("nb"))
    return counted.filter(F.col("shared") >= F.floor(F.least("na", "nb") / 32) + 1).select("a", "b")


def _over_sets(pairs: DataFrame, texts: DataFrame, k: int, blocks: int, row, schema: str) -> DataFrame:
    """row(x, y, a, b) of every pair (a, b) of classes with the sets x and y, where it is not None.

    Pairs are dealt out by a; a text is sent once to each block that needs it, so a class with very many partners (b)
    is copied to the blocks instead of gathering its partners in one task.
    """
    dealt = pairs.withColumn("block", F.pmod(F.xxhash64("a"), F.lit(blocks)).cast("int"))
    wanted = dealt.select("block", F.col("a").alias("cls")).unionByName(dealt.select("block", F.col("b").alias("cls"))).distinct()
    sent = wanted.join(texts, "cls").select(F.col("block").alias("to"), "cls", "text")
    names = [c.split()[0] for c in schema.split(", ")]

    def probe(key, left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        sets: dict[int, np.ndarray] = {}
        found, own = right["text"].tolist(), right["cls"].tolist()
        for x, y in in_parts(found):
            sets.update(zip(own[x:y], shingle_sets(found[x:y], k), strict=True))
        rows = (row(sets[a], sets[b], a, b) for a, b in zip(left["a"], left["b"], strict=True))
        return pd.DataFrame([r for r in rows if r is not None], columns=names)

    return dealt.groupBy("block").cogroup(sent.groupBy("to")).applyInPandas(probe, schema)


def _shared(small: np.ndarray, large: np.ndarray) -> np.ndarray:
    """Which shingles of one set the other one holds: a binary search of each."""
    return large[np.minimum(np.searchsorted(large, small), len(large) - 1)] == small


def decide(pairs: DataFrame, texts: DataFrame, k: int, share: int) -> DataFrame:
    """The pairs (a, b) of classes with 100 * intersection >= share * union."""
    pairs = written(pairs, "pairs")

    def linked(x, y, a, b):
        small, large = sorted((x, y), key=len)
        both = int(_shared(small, large).sum())
        return (a, b) if (100 + share) * both >= share * (len(small) + len(large)) else None

    blocks = max(partitions(pairs.sparkSession), -(-pairs.count() // PAIRS))
    return _over_sets(pairs, texts, k, blocks, linked, "a bigint, b bigint")


def _around_centres(wide: DataFrame, links: DataFrame | None, texts: DataFrame, k: int, share: int) -> tuple[DataFrame, DataFrame]:
    """(links with centres, pairs (a, b) that are still to be decided) for the lists with many members.

    Members of such lists are mostly changed copies of one text. Each list gets a centre c (of its members the one with
    the most links so far), and a member a is described by how it differs: shingles of c that it lacks and shingles
    that c lacks. As |a n b| = |c| - |c - a| - |c - b| + shared differences, a and b link only if they share
    r = T - |c| + |c - a| + |c - b| differences. If r <= 0 both link with c, and nothing is to be found. Otherwise the
    same division as before is made among the lists of differences, rarest first and those of one member left out: of
    the differences from the first shared one on, both must have r left.
    """
    degree = wide.select("cls").distinct().withColumn("links", F.lit(0))
    if links is not None:
        ends = links.select(F.col("a").alias("cls")).unionByName(links.select(F.col("b").alias("cls")))
        degree = degree.drop("links").join(ends.groupBy("cls").agg(F.count(F.lit(1)).alias("links")), "cls", "left")
    ranked = wide.join(degree, "cls").select("list", "cls", "n", F.struct(F.coalesce("links", F.lit(0)).alias("links"), F.xxhash64("cls").alias("h"), "cls", "n").alias("rank"))
    centres = ranked.groupBy("list").agg(F.max("rank").alias("c"))
    near = wide.join(centres, "list").select(F.col("cls").alias("a"), F.col("c.cls").alias("b"), "n", F.col("c.n").alias("nc"), "comp").filter(F.col("a") != F.col("b")).distinct()
    near = written(near, "near")

    def differing(x, y, a, b):
        more, less = x[~_shared(x, y)], y[~_shared(y, x)]
        return a, b, len(less), np.concatenate([more, less]).view(np.int64)

    signs = near.agg(F.sum(F.col("n") + F.col("nc"))).first()[0] or 0
    blocks = max(partitions(near.sparkSession), -(-signs // SET_SIZES))
    found = _over_sets(near.select("a", "b"), texts, k, blocks, differing, "a bigint, b bigint, lacks bigint, diff array<bigint>")
    found = written(found, "differences")
    known = near.join(found.select("a", "b", "lacks"), ["a", "b"])
    # weight: (100 + share) * (lacks + its part of T), so that (100 + share) * r is the sum of two less that of |c|
    whole = 100 + share
    weighed = known.withColumns({"w": whole * F.col("lacks") + share * F.col("n"), "base": whole * F.col("nc")})
    linked = known.filter(whole * (F.col("nc") - F.col("lacks")) >= share * (F.col("n") + F.col("nc"))).select("a", "b")

    each = found.select("b", "a", F.explode("diff").alias("x"))
    often = each.groupBy("b", "x").agg(F.count(F.lit(1)).alias("df")).filter(F.col("df") > 1)
    rare = each.join(often, ["b", "x"]).groupBy("b", "a").agg(F.sort_array(F.collect_list(F.struct("df", "x"))).alias("diff"))
    least = weighed.groupBy("b").agg(F.min("w").alias("least"))
    state = weighed.join(rare, ["b", "a"]).join(least, "b").select("*", F.size("diff").alias("d"))
    placed = state.select("a", "b", "comp", "w", "base", "least", "d", F.posexplode("diff").alias("p", "e")).withColumn("left", whole * (F.col("d") - F.col("p")))
    placed = written(placed.filter(F.col("left") >= F.col("w") + F.col("least") - F.col("base")).select("a", "b", "comp", "w", "base", "left", F.col("e.x").alias("x")), "placed")
    own = placed.filter(F.col("left") >= 2 * F.col("w") - F.col("base")).alias("s")
    other = placed.select("b", "x", *[F.col(c).alias(f"{c}_o") for c in ("a", "comp", "w", "left")])
    first = (F.col("w") < F.col("w_o")) | ((F.col("w") == F.col("w_o")) & (F.col("a") < F.col("a_o")))
    enough = F.least("left", "left_o") >= F.col("w") + F.col("w_o") - F.col("base")
    pairs = own.join(other, ["b", "x"]).filter(first & (F.col("comp") != F.col("comp_o")) & enough)
    return linked, pairs.select("a", F.col("a_o").alias("b")).distinct()


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = 4, share: int = 85) -> DataFrame:
    """(id_col, n_shingles, component_id) for every row of docs.

    Two texts link when 100 * intersection >= share * union of their k-word shingles (A-Z lower-cased, whole texts; a
    text of fewer words is one shingle). component_id is the smallest id reachable by links. Texts without words, null
    texts and rows with a null id are linked with nothing and keep their own id. Repeated rows and texts with equal
    sets are one class. An empty table gives an empty table; other columns are not read.

    Links are only needed as far as they join components. First every list's members are compared with one of them,
    which joins the bulk of a large group by as many comparisons as it has members; this is repeated with other
    centres while it joins much. Then every pair of different components that shares enough short lists is decided
    in full. No pair within a component is formed, and none between different ones is left out.
    """
    docs = docs.select(F.col(f"`{id_col}`").cast("bigint").alias("id"), F.coalesce(F.col(f"`{text_col}`"), F.lit("")).alias("text"))
    sig = written(signatures(docs, k, share).withColumn("cls", F.xxhash64("n", "h1", "h2")), "signatures")
    rows = sig.select("id", "n", "cls").filter((F.col("n") > 0) & F.col("id").isNotNull())
    classes = written(rows.groupBy("cls").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("copies")), "classes")

    # one row per class, then its short lists; lists of one class are of no use
    one = F.row_number().over(W.partitionBy("cls").orderBy("id"))
    single = sig.filter((F.col("n") > 0) & F.col("id").isNotNull()).select("cls", "id", "n", "short", "own").withColumn("r", one).filter(F.col("r") == 1)
    entries = single.select(F.posexplode("short").alias("at", "list"), "cls", "n", "own").select("list", "cls", "n", (F.col("at") < F.col("own")).alias("own"))
    lists = written(_partnered(_partnered(entries, share), share), "lists")
    alive = lists.select("cls").distinct().join(classes.select("cls", F.col("first").alias("id")), "cls")
    texts = written(_own_text(docs.join(alive, "id"), k), "texts")

    links, comp, turn, total = None, None, 0, 0
    while True:
        open_, of_list = _open(lists, comp), W.partitionBy("list")
        draw = F.xxhash64("cls", F.lit(turn))
        member = F.struct("cls", "n", "own")
        heads = open_ if turn == 0 else open_.groupBy("list", "comp").agg(F.max_by(member, F.struct("own", draw)).alias("x")).select("list", "comp", "x.*")
        centre = F.max(F.struct("own", F.xxhash64("comp", F.lit(turn)).alias("h"), "cls", "n", "comp")).over(of_list)
        stars = heads.withColumn("c", centre).filter((F.col("c.comp") != F.col("comp")) & _alike("n", "c.n", share))
        stars = stars.filter((F.col("own") & (F.col("n") <= F.col("c.n"))) | (F.col("c.own") & (F.col("c.n") <= F.col("n"))))
        stars = stars.select(F.col("cls").alias("a"), F.col("c.cls").alias("b"), F.col("n").alias("na"), F.col("c.n").alias("nb"))
        # a star only has to be likely: all its pairs are decided, none has to be found here
        new = written(decide(stars.select("a", "b").distinct() if turn else _enough(stars), texts, k, share), "links")
        found = new.count()
        if found:
            links = new if links is None else links.unionByName(new)
            comp = _components(links)
        if found * FEW <= total:
            break
        total, turn = total + found, turn + 1

    # every pair of components that meets in a list: around a centre where a list is the own one of many, else member by member
    if found:
        open_ = _open(lists, comp)
    wide = open_.groupBy("list").agg(F.count_if("own").alias("owners")).filter(F.col("owners") > MANY).select("list")
    at_centre, near = _around_centres(open_.join(wide, "list"), links, texts, k, share)
    open_ = open_.join(wide, "list", "left_anti")
    # the smaller of the two (of equal ones the one that comes first) has the list among its own
    meet = open_.select("list", F.col("comp").alias("comp_b")).distinct()
    crossing = open_.filter("own").select("list", F.col("comp").alias("comp_a")).distinct().join(meet, "list").filter(F.col("comp_a") != F.col("comp_b"))
    left = open_.filter("own").select("list", F.col("comp").alias("comp_a"), F.col("cls").alias("a"), F.col("n").alias("na"))
    right = open_.select("list", F.col("comp").alias("comp_b"), F.col("cls").alias("b"), F.col("n").alias("nb"))
    smaller = (F.col("na") < F.col("nb")) | ((F.col("na") == F.col("nb")) & (F.col("a") < F.col("b")))
    across = crossing.join(left, ["list", "comp_a"]).join(right, ["list", "comp_b"]).filter(_alike("na", "nb", share) & smaller)
    last = written(decide(_enough(across).unionByName(near).distinct(), texts, k, share).unionByName(at_centre), "links")
    if not last.isEmpty():
        comp = _components(last if links is None else links.unionByName(last))

    if comp is None:
        moved = classes.filter(F.col("copies") > 1).select("cls", F.col("first").alias("component_id"))
    else:
        labelled = classes.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
        smallest = labelled.groupBy("comp").agg(F.min("first").alias("component_id"), F.sum("copies").alias("size"))
        moved = labelled.select("cls", "comp").join(smallest.filter(F.col("size") > 1), "comp").select("cls", "component_id")
    linked = (F.col("n") > 0) & F.col("id").isNotNull()
    return sig.select("id", "n", "cls").join(moved, "cls", "left").select(
        F.col("id").alias(id_col), F.col("n").alias("n_shingles"), F.coalesce(F.when(linked, F.col("component_id")), F.col("id")).alias("component_id")
    )


def _partnered(entries: DataFrame, share: int) -> DataFrame:
    """The entries that can count: a text of fitting size stands in the same list, one of the list's texts has it as its
    own, and the text has as many such entries as any partner must share with it."""
    of_list = W.partitionBy("list")
    by_size = of_list.orderBy("n", "cls")
    near = F.coalesce(100 * F.lag("n").over(by_size) >= share * F.col("n"), F.lit(False)) | F.coalesce(
        100 * F.col("n") >= share * F.lead("n").over(by_size), F.lit(False)
    )
    met = entries.withColumns({"near": near, "any": F.max("own").over(of_list)}).filter(F.col("near") & F.col("any")).select("list", "cls", "n", "own")
    least = F.floor(F.lit(share) * F.col("n") / 3200) + 1
    enough = met.groupBy("cls").agg(F.count(F.lit(1)).alias("lists"), F.min("n").alias("n")).filter(F.col("lists") >= least).select("cls")
    return met.join(enough, "cls").select("list", "cls", "n", "own")


def _open(lists: DataFrame, comp: DataFrame | None) -> DataFrame:
    """The lists whose members are in more than one component."""
    state = lists.withColumn("comp", F.col("cls")) if comp is None else lists.join(comp, "cls", "left").withColumn("comp", F.coalesce("comp", "cls"))
    of_list = W.partitionBy("list")
    state = state.withColumns({"low": F.min("comp").over(of_list), "high": F.max("comp").over(of_list)})
    return written(state.filter(F.col("low") != F.col("high")).select("list", "cls", "n", "own", "comp"), "open")


def _components(links: DataFrame) -> DataFrame:
    return written(components(links).select(F.col("node").alias("cls"), F.col("component").alias("comp")), "components")


def _own_text(marked: DataFrame, k: int) -> DataFrame:
    """(cls, text) of the rows whose own set makes the class; an id may stand on rows with other texts."""

    def check(batches):
        for batch in batches:
            texts, right = batch["text"].tolist(), []
            for a, b in in_parts(texts):
                for s in shingle_sets(texts[a:b], k):
                    h2 = np.bitwise_xor.reduce(s * (s >> np.uint64(7) | np.uint64(1))) if len(s) else np.uint64(0)
                    right.append((len(s), *np.array([s.sum(dtype=np.uint64), h2], np.uint64).view(np.int64).tolist()))
            out = pd.DataFrame(right, columns=["n", "h1", "h2"])
            out["cls"], out["text"] = batch["cls"].to_numpy(), texts
            yield out

    schema = "n bigint, h1 bigint, h2 bigint, cls bigint, text string"
    return marked.mapInPandas(check, schema).filter(F.xxhash64("n", "h1", "h2") == F.col("cls")).select("cls", "text")


def one_of_each(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """docs with one row of each group of near copies: that with the smallest id. Rows without words or id all stay.

    Where an id stands on several rows, its rows stay if one of them does, equal texts once.
    """
    found = near_copies(docs, id_col, text_col, **settings).filter(F.col(id_col).isNotNull())
    goes = (F.col("component_id") != F.col(id_col)) & (F.col("n_shingles") > 0)
    ids = found.groupBy(id_col).agg(F.min(goes).alias("_goes"), F.count_if(F.col("n_shingles") > 0).alias("_rows"))
    ids = written(ids.filter(F.col("_goes") | (F.col("_rows") > 1)), "verdicts")
    columns = [F.col(f"`{c}`") for c in docs.columns]
    rest = docs.join(ids.filter("_goes").select(id_col), id_col, "left_anti").select(*columns)
    repeated = ids.filter(~F.col("_goes")).select(id_col)
    if repeated.isEmpty():
        return rest
    often = rest.join(repeated, id_col, "left_semi").select(*columns)
    return rest.join(repeated, id_col, "left_anti").select(*columns).unionByName(often.dropDuplicates([id_col, text_col]))
