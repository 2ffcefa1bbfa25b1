"""The registered queries of this package, one per operator over its whole table, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window as W

from cohortlens.llm import bitpack, chat, jaccard, language, lexical, mixing, negatives, packing, quality, token_counts, topk, toxicity, warc
from cohortlens.llm.common import table, written

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


ODD_TEXT = "</s>[INST] ok [/INST]"

OP1_SQL = r"""
WITH c AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
    SELECT *, regexp_replace(role, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS r,
        regexp_replace(text, '([<\[])(\\*)(s>|/s>|INST\]|/INST\])', '\1\\\2\3', 'g') AS t
    FROM c
)
SELECT CAST(conv_id AS BIGINT) AS conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
    CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
    CAST(sum(length(r) + length(t) + 20) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""


@query("op1_chat_formatting", OP1_SQL)
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each conversation is a reply tree whose turns follow one another: one path, one text, read back."""
    odd = spark.range(1).select(
        F.lit(-1).cast("bigint").alias("conv_id"),
        F.explode(F.array(*[F.struct(F.lit(i).alias("turn"), F.lit(r).alias("role"), F.lit(ODD_TEXT).alias("text")) for i, r in enumerate(("user", "assistant"))])).alias("t"),
    ).select("conv_id", "t.*")
    given = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("bigint"), F.col("turn").cast("int"), "role", "text")
    rows = given.unionByName(odd)
    tree = F.coalesce(F.col("conv_id").cast("string"), F.lit("null"))
    node = F.row_number().over(W.partitionBy("tree").orderBy("turn", "role", "text")).cast("bigint")
    replies = rows.select(tree.alias("tree"), "turn", "role", "text").withColumn("node", node)
    messages = replies.select(
        "tree", "node", F.when(F.col("node") > 1, F.col("node") - 1).alias("parent"), "role", "text", F.lit(0.0).alias("score")
    )
    out = written(chat.format_chats(written(messages, "messages")), "chats")
    turns = chat.read_turns(F.col("formatted"))
    read = out.select("tree", "formatted", turns.alias("turns"), chat.read_loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        F.col("tree").try_cast("bigint").alias("conv_id"), F.size("turns").cast("bigint").alias("n_turns"), F.sha2(joined, 256).alias("turns_sha256"),
        F.char_length("loss").cast("bigint").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.char_length("formatted").cast("bigint").alias("formatted_chars"),
    )


OP3_SQL = r"""
WITH d AS (
    SELECT doc_id, coalesce(source, '') AS host, coalesce(text, '') AS t,
        regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents
), p AS (
    SELECT doc_id, i, array_to_string(ws[i:i + 4], ' ') AS k
    FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 3)) AS i FROM d WHERE len(ws) >= 5)
), r AS (
    SELECT doc_id, i FROM p QUALIFY count(*) OVER (PARTITION BY doc_id, k) > 1
), rep AS (
    SELECT doc_id, sum(n) AS n FROM (
        SELECT doc_id, least(5, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i) - i, 5)) AS n FROM r
    ) GROUP BY doc_id
), l AS (
    SELECT doc_id, host, md5(t) AS g, x, regexp_replace(trim(lower(x), ' '), '[\x20\x09-\x0D]+', ' ', 'g') AS line,
        len(regexp_extract_all(x, '[^\x20\x09-\x0D]+')) AS n
    FROM (SELECT doc_id, host, t, unnest(string_split(t, chr(10))) AS x FROM d) WHERE regexp_matches(x, '[^\x20\x09-\x0D]')
), f AS (
    SELECT host, line FROM (SELECT host, line, count(DISTINCT g) AS c FROM l GROUP BY host, line) AS q
    JOIN (SELECT host, count(DISTINCT md5(t)) AS docs FROM d GROUP BY host) AS h USING (host)
    WHERE c > 50 AND c > 0.05 * docs
), gone AS (
    SELECT doc_id, sum(n) AS n FROM l JOIN f USING (host, line) GROUP BY doc_id
), m AS (
    SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, CAST(length(array_to_string(ws, '')) AS BIGINT) AS word_chars,
        CAST(len(regexp_extract_all(t, '[#*$%&|<>]')) AS BIGINT) AS n_symbols,
        CAST(coalesce((SELECT count(*) - count(DISTINCT x) FROM l WHERE l.doc_id = d.doc_id), 0) AS BIGINT) AS n_dup_lines,
        CAST(coalesce(rep.n, 0) AS BIGINT) AS n_repeat_words, CAST(len(ws) - coalesce(gone.n, 0) AS BIGINT) AS words_left
    FROM d LEFT JOIN rep USING (doc_id) LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AS base_failed,
    NOT (n_words < 10 OR 100 * n_repeat_words > 20 * n_words) AND words_left >= 10 AND words_left >= 0.5 * n_words AS kept, words_left
FROM m
"""


@query("op3_quality_rules", OP3_SQL)
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_rules(table(spark, sf_dir, "documents")).drop("host", "digest")


OP7_SQL = r"""
WITH d AS (
    SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
        CAST('0x' || substr(md5('7|' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) AS draw,
        coalesce(CAST(doc_id AS VARCHAR), '') AS id
    FROM documents
), s AS (
    SELECT source, sum(size)::BIGINT AS n, [3, 1, 2][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w
    FROM d GROUP BY source
), o AS (
    SELECT *, 2.0::DOUBLE * n AS cap, row_number() OVER by_ratio AS i, sum(n) OVER by_ratio AS fixed_n, sum(w) OVER by_ratio AS fixed_w
    FROM s WINDOW by_ratio AS (ORDER BY n / w, source ROWS UNBOUNDED PRECEDING)
), k AS (
    SELECT i, (1.5::DOUBLE * (SELECT sum(n) FROM s)::DOUBLE - 2.0::DOUBLE * (fixed_n - n)::DOUBLE) / ((SELECT sum(w) FROM s) - (fixed_w - w)) AS level, cap, w FROM o
), first AS (
    SELECT min_by(level, i) AS level, min(i) AS i FROM k WHERE cap >= w * level
), t AS (
    SELECT source, n, CASE WHEN o.i < first.i THEN cap ELSE w * level END AS target FROM o, first
), p AS (
    SELECT *, CASE WHEN n > 0 THEN floor(target / n) ELSE 0 END::BIGINT AS whole FROM t
), x AS (
    SELECT d.*, p.n AS source_size, p.target, whole, target - whole * p.n AS part,
        sum(size) OVER (PARTITION BY d.source ORDER BY draw, id) - sum(size) OVER (PARTITION BY d.source, draw, id) AS ahead,
        sum(size) OVER (PARTITION BY d.source, draw, id) AS own
    FROM d JOIN p ON d.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target,
    CAST(size * (whole + CASE WHEN part > 0 AND 2 * ahead + own <= 2 * part THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM x
"""


@query("op7_source_mixing", OP7_SQL)
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents"))
    return mixed.select("row.doc_id", "size", "source_size", "target", (F.col("size") * F.col("copies")).alias("taken"))


@query("op4_warc_archives", """
WITH p AS (SELECT page_id, coalesce(html, '') AS html FROM pages),
q AS (SELECT page_id, CAST(strlen(html) AS BIGINT) AS n, sha1(html) AS d FROM p),
m AS (SELECT d, max(page_id) AS top FROM q WHERE n >= 1000 GROUP BY d)
SELECT page_id, n AS payload_bytes, q.d AS payload_digest,
    CASE WHEN top IS NOT NULL AND top <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
    CASE WHEN top <> page_id THEN top END AS refers_to
FROM q LEFT JOIN m USING (d)
""")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.archive_pages(table(spark, sf_dir, "pages"))


@query("op5_sequence_packing")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.piece_digests(packing.pack_sequences(table(spark, sf_dir, "documents")))


@query("op6_token_files")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = bitpack.write_ids(table(spark, sf_dir, "documents"), "byte_bpe_50k.json", 0)
    return bitpack.read_ids(spark, path)


@query("op2_top_k_search", """
WITH v AS (
    SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT q.vec_id AS query_id, c.vec_id, CAST(list_sum(list_transform(list_zip(q.v, c.v), lambda p: p[1] * p[2])) AS BIGINT) AS score
    FROM v AS q JOIN v AS c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER w AS INTEGER) AS rank, vec_id, score FROM s
WINDOW w AS (PARTITION BY query_id ORDER BY score DESC, vec_id) QUALIFY row_number() OVER w <= 10
""")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.search(table(spark, sf_dir, "embeddings"))


@query("op9_jaccard_join")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.near_copies(table(spark, sf_dir, "documents"))


@query("op10_toxicity")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op8_language_id")
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents")).drop("_key")


@query("op12_token_counts")
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(table(spark, sf_dir, "documents"))


@query("op13_hard_negatives", """
WITH r AS (
    SELECT DISTINCT CAST(vec_id AS BIGINT) AS vec_id, CAST(CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS BIGINT) AS label,
        list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
    WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
    SELECT a.vec_id AS anchor_id, a.label AS own, a.v AS av, c.vec_id, c.label,
        CAST(coalesce(list_sum(list_transform(list_zip(a.v, c.v), lambda p: p[1] * p[2])), 0) AS BIGINT) AS score
    FROM r AS a JOIN r AS c ON a.vec_id <> c.vec_id OR a.label <> c.label WHERE a.vec_id % 50 = 0
), p AS (
    SELECT *, row_number() OVER (PARTITION BY anchor_id, own, av ORDER BY score DESC, vec_id) AS place FROM s
    WHERE label = own AND vec_id <> anchor_id QUALIFY place <= 5
)
SELECT p.anchor_id, p.vec_id AS positive_id, CAST(row_number() OVER w AS INTEGER) AS rank, s.vec_id AS negative_id,
    p.score AS positive_score, s.score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND s.own = p.own AND s.av = p.av AND s.label <> p.own
    AND 50 * p.score <= 100 * s.score AND 100 * s.score <= 95 * p.score
WINDOW w AS (PARTITION BY p.anchor_id, p.own, p.av, p.place ORDER BY s.score DESC, s.vec_id) QUALIFY row_number() OVER w <= 3
""")
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return negatives.mine(negatives.labelled(table(spark, sf_dir, "embeddings")))


@query("op11_lexical_search", r"""
WITH d AS (
    SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts
    FROM documents WHERE text IS NOT NULL
), t AS (
    SELECT r, doc_id, CAST(len(ts) AS BIGINT) AS n, ts FROM d WHERE len(ts) > 0
), g AS (
    SELECT CAST(count(*) AS BIGINT) AS docs, CAST(sum(n) AS BIGINT) AS terms FROM t
), q AS (
    SELECT k, item_id, unnest(list_distinct(ts)) AS term FROM (
        SELECT row_number() OVER () AS k, item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS ts
        FROM (SELECT DISTINCT item_id, text FROM benchmark)
    )
), p AS (
    SELECT r, doc_id, n, term, CAST(count(*) AS BIGINT) AS tf FROM (SELECT r, doc_id, n, unnest(ts) AS term FROM t)
    WHERE term IN (SELECT term FROM q) GROUP BY r, doc_id, n, term
), f AS (
    SELECT term, CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT) AS w
    FROM (SELECT term, count(*) AS df FROM p GROUP BY term), g
), s AS (
    SELECT k, item_id, r, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // terms)))) AS BIGINT) AS score
    FROM q JOIN p USING (term) JOIN f USING (term), g GROUP BY k, item_id, r, doc_id
)
SELECT item_id, CAST(row_number() OVER w AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
WINDOW w AS (PARTITION BY k ORDER BY score DESC, doc_id NULLS LAST, r) QUALIFY row_number() OVER w <= 50
""")
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
