"""Quality rules: word and repetition rules per document, and lines that many documents of a host share.

DataFrame operations only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cohortlens.llm.common import WORD, written

#: A line is boilerplate on its host if more documents hold it than this number and this share of the host's documents.
MIN_DOCS, SHARE = 50, 0.05
#: A document is depleted if fewer words remain than this number or this share of them.
MIN_WORDS, REMAINS = 10, 0.5
WINDOW = 5


def _line_hash(line: Column) -> Column:
    """Equal for lines that differ in case and blanks alone."""
    return F.xxhash64(F.regexp_replace(F.trim(F.lower(line)), r"[\x20\x09-\x0D]+", " "))


def _with_words(lines: Column) -> Column:
    return F.filter(lines, lambda x: x.rlike(r"[^\x20\x09-\x0D]"))


def text_measures(docs: DataFrame) -> DataFrame:
    """Adds n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed from the column _text.

    Windows that occur twice are found by sorting one row's window hashes, so a row costs n log n for any length, and
    the sort is left out where all windows differ.
    """
    words = docs.withColumn("_words", F.regexp_extract_all("_text", F.lit(WORD), F.lit(0)))
    hashed = words.withColumn("_h", F.transform("_words", lambda w: F.xxhash64(w)))
    h = F.col("_h")
    windows = F.transform(
        F.slice(h, 1, F.greatest(F.size(h) - WINDOW + 1, F.lit(0))),
        lambda x, i: F.xxhash64(x, *[F.get(h, i + j) for j in range(1, WINDOW)]),
    )
    lines = _with_words(F.split("_text", "\n", -1))
    measured = hashed.select(
        *[c for c in docs.columns if c != "_text"],
        F.size("_words").cast("bigint").alias("n_words"),
        F.char_length(F.array_join("_words", "")).cast("bigint").alias("word_chars"),
        F.regexp_count("_text", F.lit(r"[#*$%&|<>]")).cast("bigint").alias("n_symbols"),
        lines.alias("_lines"), windows.alias("_win"),
    )
    win, lines = F.col("_win"), F.col("_lines")
    again = F.size(F.array_distinct(win)) < F.size(win)
    sorted_ = measured.withColumns({
        "n_dup_lines": (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"),
        "_at": F.when(again, F.array_sort(F.transform(win, lambda x, i: F.struct(x.alias("h"), i.alias("i"))))),
    }).drop("_lines", "_win")
    at = F.col("_at")
    twice = F.filter(at, lambda e, i: (F.get(at, i - 1)["h"] == e["h"]) | (F.get(at, i + 1)["h"] == e["h"]))
    found = sorted_.withColumn("_pos", F.array_sort(F.transform(twice, lambda e: e["i"]))).drop("_at")
    pos = F.col("_pos")
    steps = F.transform(pos, lambda p, i: F.least(F.lit(WINDOW), F.coalesce(F.get(pos, i + 1) - p, F.lit(WINDOW))))
    covered = F.aggregate(steps, F.lit(0), lambda a, x: a + x)
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return (
        found.withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
        .withColumn("base_failed", failed)
        .drop("_pos")
    )


def _prepared(docs: DataFrame, id_col: str, text_col: str, host_col: str) -> DataFrame:
    text = F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    return docs.select(
        F.col(f"`{id_col}`").alias("id"), F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"),
        F.md5(text).alias("digest"), text.alias("_text"),
    )


def shared_lines(prepared: DataFrame, copies: DataFrame, min_docs: int, share: float) -> DataFrame:
    """(host, digest, line, words): the boilerplate lines of each text, words times the copies of the text.

    Texts are counted, not rows: exact copies of one text are one document. Words and counts are first summed per
    (host, line, text), so a line that a third of all documents hold is spread over many tasks.
    """
    lines = prepared.select("host", "digest", F.explode(_with_words(F.split("_text", "\n", -1))).alias("t"))
    lines = lines.select("host", "digest", _line_hash(F.col("t")).alias("line"), F.regexp_count("t", F.lit(WORD)).alias("words"))
    per_text = written(lines.groupBy("host", "line", "digest").agg(F.sum("words").alias("words")), "lines")
    counts = per_text.groupBy("host", "line").agg(F.count(F.lit(1)).alias("n")).filter(F.col("n") > min_docs)
    hosts = copies.groupBy("host").agg(F.count(F.lit(1)).alias("docs"))
    frequent = counts.join(hosts, "host").filter(F.col("n") > share * F.col("docs")).select("host", "line")
    return per_text.join(frequent, ["host", "line"])


def quality_rules(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", host_col: str = "source",
    min_docs: int = MIN_DOCS, share: float = SHARE, min_words: int = MIN_WORDS, remains: float = REMAINS,
) -> DataFrame:
    """One row per row of docs: id_col, the measures, words_left and kept.

    A document fails the base rules with fewer than 10 words or more than a fifth of its words in repeated five-word
    windows. Lines held by more than max(min_docs, share of the host's documents) distinct texts of a host are
    boilerplate; a document with fewer than max(min_words, remains of its words) outside them is depleted. Null text
    is an empty text, a null host is a host of its own (shared with the empty one), ids may repeat or be null: rows
    with equal text and host get equal results. An empty table gives an empty table; other columns are not read.
    """
    prepared = _prepared(docs, id_col, text_col, host_col)
    base = written(text_measures(prepared), "measures")
    copies = base.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("copies"))
    lost = shared_lines(prepared, copies, min_docs, share).groupBy("host", "digest").agg(F.sum("words").alias("gone"))
    lost = lost.join(copies, ["host", "digest"]).select("host", "digest", (F.col("gone") / F.col("copies")).cast("bigint").alias("gone"))
    left = F.col("n_words") - F.coalesce(F.col("gone"), F.lit(0))
    depleted = (left < min_words) | (left < remains * F.col("n_words"))
    return base.join(lost, ["host", "digest"], "left").select(
        F.col("id").alias(id_col), "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
        (~F.col("base_failed") & ~depleted).alias("kept"), left.alias("words_left"), "host", "digest",
    )


def clean_documents(docs: DataFrame, **settings) -> DataFrame:
    """The kept rows of docs, boilerplate lines taken out of their texts (n_chars follows where it is a column).

    How many boilerplate lines a text can hold is bounded: each is in over min_docs and over a share of its host's
    texts, so there are at most 1 / share times as many on a host as a text has lines on average.
    """
    id_col, text_col, host_col = (settings.get(k, v) for k, v in (("id_col", "doc_id"), ("text_col", "text"), ("host_col", "source")))
    min_docs, share = settings.get("min_docs", MIN_DOCS), settings.get("share", SHARE)
    min_words, remains = settings.get("min_words", MIN_WORDS), settings.get("remains", REMAINS)
    prepared = _prepared(docs, id_col, text_col, host_col)
    base = written(text_measures(prepared).drop("word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"), "measures")
    copies = base.groupBy("host", "digest").agg(F.count(F.lit(1)).alias("copies"), F.max("n_words").alias("n_words"), F.max("base_failed").alias("failed"))
    lines = shared_lines(prepared, copies.select("host", "digest"), min_docs, share)
    gone = lines.groupBy("host", "digest").agg(F.sum("words").alias("gone"), F.collect_set("line").alias("_gone"))
    left = F.col("n_words") - F.coalesce(F.col("gone") / F.col("copies"), F.lit(0))
    bad = F.col("failed") | (left < min_words) | (left < remains * F.col("n_words"))
    verdict = copies.join(gone, ["host", "digest"], "left").select("host", "digest", bad.alias("bad"), "_gone")
    verdict = written(verdict.filter(F.col("bad") | F.col("_gone").isNotNull()), "verdicts")

    given = F.col(f"`{text_col}`")
    keyed = docs.select(
        F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), given.alias("given"), F.md5(F.coalesce(given, F.lit(""))).alias("digest"),
        F.coalesce(F.col(f"`{host_col}`").cast("string"), F.lit("")).alias("host"),
    )
    rows = keyed.join(verdict, ["host", "digest"], "left").filter(~F.coalesce(F.col("bad"), F.lit(False)))
    gone = F.col("_gone")
    stays = F.filter(F.split("given", "\n", -1), lambda x: ~(x.rlike(r"[^\x20\x09-\x0D]") & F.array_contains(gone, _line_hash(x))))
    rows = rows.withColumn("left", F.when(gone.isNotNull(), F.array_join(stays, "\n")))
    changed = {text_col: F.coalesce("left", "given")}
    if "n_chars" in docs.columns:
        n = F.char_length("left").cast(docs.schema["n_chars"].dataType)
        changed["n_chars"] = F.coalesce(n, F.col("row.n_chars"))
    return rows.select(*[changed.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])
