"""Language by Bayesian fusion: text likelihoods, declared language, and host priors smoothed towards their suffix.

Text likelihoods are byte trigrams under one smoothed model per language. Priors are grouped counts of what the texts
alone say: all documents, then those of an address suffix (org, de), then those of a host, each smoothed by the one
before. How often a language is declared as what it is, or as another, is counted in the same way.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import written
from cohortlens.llm.shingles import in_parts

#: Distinct texts of each declared language that its model is fitted on, at most in expectation; a language that fewer
#: than LEAST documents declare is not modelled.
PER_LANGUAGE, LEAST = 5_000, 10
CELLS = 1 << 16
#: Neighbouring trigrams overlap: each counts as a third of an observation. Likelihoods are whole thousandths.
TEMPER, UNIT = 1 / 3, 1000.0
HOST, SUFFIX, DECLARED = 10.0, 20.0, 5.0
CONFIDENT = 0.6
#: A text is in no known language if its trigrams are less likely under the best model than those of the model's own
#: left-out texts: LOW is the quantile that they reach, as far again (SPREAD nats at least) is still heard, and so many
#: standard errors (short texts vary).
LOW, SPREAD, ERRORS = 0.05, 0.5, 2.0
#: Share of a language's likelihood that is spread evenly over all cells.
SMOOTH = 0.02
SALTS = 32
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def trigram_cells(data: np.ndarray) -> np.ndarray:
    x = _LOWER[data].astype(np.uint32)
    code = x[:-2] << np.uint32(16) | x[1:-1] << np.uint32(8) | x[2:]
    return (code * np.uint32(2654435761)) >> np.uint32(16)


def declared_in_page(html: Column) -> Column:
    """The language that a page's root element declares."""
    return F.regexp_extract(html, r"(?i)<html\b[^>]*\slang\s*=\s*[\"']?([a-z]{2,3})\b", 1)


def host_of(url: Column) -> Column:
    return F.lower(F.regexp_extract(url, r"(?i)^[a-z][a-z0-9+.-]*://(?:[^/@]*@)?([^/:?#]+)", 1))


def _plain(declared: Column) -> Column:
    """Two or three letters, else nothing: at most 18,278 different values."""
    return F.regexp_extract(F.lower(F.coalesce(declared.cast("string"), F.lit(""))), r"^\s*([a-z]{2,3})(?:[-_].*)?\s*$", 1)


@dataclass
class Models:
    """Languages, log-likelihoods (cells x languages, in thousandths), and what a language's own left-out texts reach:
    a trigram's mean log-likelihood that is still heard, and the variance of one trigram."""

    languages: list[str]
    table: np.ndarray
    heard: list[float]
    variance: list[float]


def _chance(counts: np.ndarray) -> np.ndarray:
    return (1 - SMOOTH) * counts / max(1.0, counts.sum()) + SMOOTH / CELLS


def _mean_scores(cells: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Sums over the cells of one text, in blocks that hold about 4 million numbers."""
    block = max(256, (1 << 22) // max(1, table.shape[1]))
    return sum(table[cells[i : i + block]].sum(0, dtype=np.int64) for i in range(0, len(cells), block)) / max(1, len(cells))


def trigram_models(docs: DataFrame, seed: int = 5) -> Models:
    """One model for every language that LEAST documents declare, from a bounded number of each by hash of
    the text: how many rows or languages there are doesn't decide which languages exist."""
    spark = docs.sparkSession
    said = docs.filter((F.col("declared") != "") & (F.octet_length("text") > 2))
    sizes = said.groupBy("declared", "key").count().groupBy("declared").agg(F.count(F.lit(1)).alias("texts"), F.sum("count").alias("docs"))
    sizes = F.broadcast(sizes.filter(F.col("docs") >= LEAST))  # at most 18,278 rows
    draw = F.pmod(F.xxhash64("text", F.lit(seed)), F.lit(1 << 20)) / float(1 << 20)
    sample = said.join(sizes, "declared").filter(draw < PER_LANGUAGE / F.col("texts"))
    sample = written(sample.select("declared", "key", "text").dropDuplicates(["declared", "key"]), "sample")

    def count(batches):
        sums: dict[str, np.ndarray] = {}

        def all_sums():
            return pd.DataFrame({"declared": list(sums), "n": [x.tobytes() for x in sums.values()]})

        for batch in batches:
            for lang, text in zip(batch["declared"], batch["text"], strict=True):
                c = np.bincount(trigram_cells(np.frombuffer(text.encode(), np.uint8)), minlength=CELLS).astype("<u4")
                if lang in sums:
                    sums[lang] += c
                else:
                    sums[lang] = c
            if len(sums) > 128:
                yield all_sums()
                sums.clear()
        if sums:
            yield all_sums()

    def add(batches):
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, n in zip(batch["declared"], batch["n"], strict=True):
                sums[lang] = sums.get(lang, 0) + np.frombuffer(n, "<u4")
        if sums:
            yield pd.DataFrame({"declared": list(sums), "n": [x.tobytes() for x in sums.values()]})

    schema = "declared string, n binary"
    tables = sample.select("declared", "text").mapInPandas(count, schema).repartition(16, "declared").mapInPandas(add, schema)
    counts = {r.declared: np.frombuffer(r.n, "<u4") for r in sorted(tables.collect(), key=lambda r: r.declared)}
    if not counts:
        return Models([], np.zeros((CELLS, 0), np.int16), [], [])
    languages, logs, variance = list(counts), [], []
    for c in counts.values():
        chance = _chance(c)
        log = np.log(chance)
        logs.append(np.rint(UNIT * log).astype(np.int16))
        variance.append(float((chance * log * log).sum() - (chance * log).sum() ** 2))
    table = np.array(logs).T.copy()
    shared = spark.sparkContext.broadcast((counts, table))

    def left_out(batches):
        """Each text under its language's model without the text itself, where no other model explains it better."""
        own, all_logs = shared.value
        at = {lang: i for i, lang in enumerate(own)}
        for batch in batches:
            rows = []
            for lang, text in zip(batch["declared"], batch["text"], strict=True):
                cells = trigram_cells(np.frombuffer(text.encode(), np.uint8))
                c = own[lang]
                mine = np.bincount(cells, minlength=CELLS)[cells]
                rest = max(1, int(c.sum(dtype=np.int64)) - len(cells))
                reached = float(np.log((1 - SMOOTH) * (c[cells] - mine) / rest + SMOOTH / CELLS).mean())
                others = _mean_scores(cells, all_logs)
                others[at[lang]] = -np.inf
                if reached * UNIT >= others.max():
                    rows.append((lang, reached))
            yield pd.DataFrame(rows, columns=["declared", "reached"])

    reached = sample.select("declared", "text").mapInPandas(left_out, "declared string, reached double")
    found = {r.declared: r.q for r in reached.groupBy("declared").agg(F.percentile("reached", F.array(F.lit(LOW), F.lit(0.5))).alias("q")).collect()}
    even = -float(np.log(CELLS))  # a language none of whose texts is its own
    heard = [2 * q[0] - max(q[1], q[0] + SPREAD) if (q := found.get(x)) else even for x in languages]
    return Models(languages, table, heard, variance)


def text_scores(docs: DataFrame, models: np.ndarray) -> DataFrame:
    """Adds n (trigrams) and scores (summed log-likelihoods, thousandths) to (id, key, declared, host); drops the text."""
    shared = docs.sparkSession.sparkContext.broadcast(models)  # 128 KB a language

    def score(batches):
        table = shared.value
        block = max(256, (1 << 22) // table.shape[1])
        for batch in batches:
            texts, n, sums = batch["text"].tolist(), [], []
            for a, b in in_parts(texts, 1 << 20):
                raw = [t.encode() for t in texts[a:b]]
                sizes = np.array([len(r) for r in raw])
                cells = trigram_cells(np.frombuffer(b"".join(raw) + b"  ", np.uint8))
                own = np.maximum(sizes - 2, 0)
                text_of = np.repeat(np.arange(len(raw)), own)
                at = np.arange(len(text_of)) + np.repeat(np.cumsum(sizes) - sizes - (np.cumsum(own) - own), own)
                total = np.zeros((len(raw), table.shape[1]), np.int64)
                for i in range(0, len(at), block):
                    whose = text_of[i : i + block]
                    first = np.flatnonzero(np.diff(whose, prepend=-1))
                    total[whose[first]] += np.add.reduceat(table[cells[at[i : i + block]]], first, axis=0, dtype=np.int64)
                n.append(own)
                sums.append(total)
            out = batch.drop(columns="text")
            out["n"], out["scores"] = np.concatenate(n), list(np.concatenate(sums))
            yield out

    schema = "id bigint, key bigint, declared string, host string, n bigint, scores array<bigint>"
    return docs.select("id", "key", "declared", "host", "text").mapInPandas(score, schema)


def _votes(rows: DataFrame, by: list[str], languages: list[str]) -> DataFrame:
    """Documents per language by what their texts say, one array per group."""
    counted = rows.groupBy(*by, "vote").agg(F.count(F.lit(1)).cast("double").alias("n"))
    pairs = F.collect_list(F.when(F.col("vote").isNotNull(), F.struct(F.col("vote").cast("int").alias("vote"), "n")))  # one a language at most
    counted = counted.groupBy(*by).agg(F.map_from_entries(pairs).alias("of"))
    votes = F.transform(F.sequence(F.lit(0), F.lit(len(languages) - 1)), lambda i: F.coalesce(F.element_at("of", i), F.lit(0.0)))
    return counted.select(*by, votes.alias("votes"))


def _sum(x: Column) -> Column:
    return F.aggregate(x, F.lit(0.0), lambda a, b: a + b)


def _smoothed(votes: Column, prior: Column, strength: float) -> Column:
    total = _sum(votes) + strength
    return F.zip_with(votes, prior, lambda v, p: (v + strength * p) / total)


def identify(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", declared: Column | None = None, host: Column | None = None) -> DataFrame:
    """(id_col, declared, language, posterior, by_text, n_trigrams, kept, reason, _key) for every row of docs.

    declared: the language that the markup or the table declares (default: column lang); host: the address's host
    (default: column source); its suffix is what follows the last dot. Rejected (kept false): no_text (fewer than three
    bytes, null texts among them), unknown (its trigrams are less likely under the best
    model than those of that language's own left-out texts), uncertain
    (no language reaches a posterior of 0.6). Null or odd declarations say nothing; a null host is the empty host, and
    what one host or declaration holds of all rows doesn't matter: groups are counts, and rows meet them salted. Rows
    with equal text, declaration and host get equal results; ids may repeat or be null. Without any declared text
    nothing can be learned and every row is unknown; an empty table gives an empty table.
    """
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    rows = docs.select(
        F.col(f"`{id_col}`").cast("bigint").alias("id"), F.xxhash64(text).alias("key"), _plain(F.col("lang") if declared is None else declared).alias("declared"),
        F.coalesce((F.col("source") if host is None else host).cast("string"), F.lit("")).alias("host"), text.alias("text"),
    )
    models = trigram_models(rows)
    languages = models.languages
    none = F.lit(None)
    if not languages:
        return rows.select(
            F.col("id").alias(id_col), "declared", none.cast("string").alias("language"), F.lit(0.0).alias("posterior"), none.cast("string").alias("by_text"),
            F.greatest(F.octet_length("text") - 2, F.lit(0)).cast("bigint").alias("n_trigrams"), F.lit(False).alias("kept"), F.lit("unknown").alias("reason"), F.col("key").alias("_key"),
        )
    names = F.array(*[F.lit(x) for x in languages])
    scored = text_scores(rows, models.table)
    best = F.array_max("scores")
    at = (F.array_position("scores", best) - 1).cast("int")
    least, error = F.array(*[F.lit(x) for x in models.heard]), F.array(*[F.lit(ERRORS * float(np.sqrt(v / TEMPER))) for v in models.variance])
    heard = (F.col("n") > 0) & (best > UNIT * (F.get(least, at) * F.col("n") - F.get(error, at) * F.sqrt("n")))
    scored = written(scored.withColumn("vote", F.when(heard, F.array_position("scores", best) - 1)), "scores")

    everywhere = _votes(scored, [], languages).first().votes
    total = sum(everywhere)
    flat = F.array(*[F.lit((v + 1.0) / (total + len(languages))) for v in everywhere])
    suffix = F.when(F.col("host").contains("."), F.substring_index("host", ".", -1)).otherwise("")
    hosts = _votes(scored, ["host"], languages).withColumn("suffix", suffix)
    suffixes = _votes(scored.withColumn("suffix", suffix), ["suffix"], languages).withColumnRenamed("votes", "of_suffix")
    hosts = hosts.join(suffixes, "suffix").select("host", _smoothed(F.col("votes"), _smoothed(F.col("of_suffix"), flat, SUFFIX), HOST).alias("prior"))

    said = _votes(scored.filter(F.col("declared") != ""), ["declared"], languages)
    spoken = [float(v) for v in everywhere]
    share = _sum(F.col("votes")) / max(1.0, total)
    chance = F.transform("votes", lambda v, i: (v + DECLARED * share) / (F.get(F.array(*[F.lit(x) for x in spoken]), i) + DECLARED))
    said = F.broadcast(said.select("declared", chance.alias("chance")))  # at most 18,278 rows

    salted = hosts.withColumn("salt", F.explode(F.array(*[F.lit(i) for i in range(SALTS)])))
    met = scored.withColumn("salt", F.pmod("key", F.lit(SALTS)).cast("int")).join(salted, ["host", "salt"]).join(said, "declared", "left")
    tiny = F.lit(1e-9)
    logs = F.transform(
        "scores", lambda s, i: s * F.lit(TEMPER / UNIT) + F.log(F.get("prior", i)) + F.coalesce(F.log(F.greatest(F.get("chance", i), tiny)), F.lit(0.0))
    )
    met = met.withColumn("logs", logs).withColumn("top", F.array_max("logs"))
    sure = 1 / _sum(F.transform("logs", lambda x: F.exp(x - F.col("top"))))
    out = met.select(
        F.col("id").alias(id_col), "declared", F.get(names, (F.array_position("logs", F.col("top")) - 1).cast("int")).alias("language"), sure.alias("posterior"),
        F.get(names, F.col("vote").cast("int")).alias("by_text"), F.col("n").alias("n_trigrams"), F.col("key").alias("_key"),
    )
    reason = F.when(F.col("n_trigrams") == 0, "no_text").when(F.col("by_text").isNull(), "unknown").when(F.col("posterior") < CONFIDENT, "uncertain")
    return out.withColumn("reason", reason).withColumn("kept", F.col("reason").isNull())


def spoken_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", **settings) -> DataFrame:
    """The rows of docs that identify keeps, all columns as they are."""
    goes = identify(docs, id_col, text_col, **settings).filter(~F.col("kept"))
    goes = goes.select(F.col(id_col).cast("string").alias("id"), F.col("_key").alias("key")).distinct()
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(f"`{id_col}`").cast("bigint").cast("string").alias("id"),
        F.xxhash64(F.coalesce(F.col(f"`{text_col}`"), F.lit(""))).alias("key"),
    )
    same = (keyed["key"] == goes["key"]) & keyed["id"].eqNullSafe(goes["id"])
    return keyed.join(goes, same, "left_anti").select("row.*")
