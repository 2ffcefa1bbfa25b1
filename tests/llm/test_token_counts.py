"""Token counts against the library's encoding of the whole text."""

import functools

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import token_counts
from cohortlens.llm.queries import QUERIES

public_tokenizers = pytest.importorskip("public_tokenizers")


@functools.cache
def library():
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=public_tokenizers.path("piece_bpe_32k.model"))


def plain(text):
    return len(library().encode(text or ""))


def odd_texts():
    rng = np.random.default_rng(4)
    words = ["".join(rng.choice(list("abcdefghijé中▁ "), rng.integers(1, 9))) for _ in range(400)]
    long = " ".join(rng.choice(words, 900))
    return [
        None, "", " ", "a", "▁", "<s> [INST] </s><unk><0x0A>", long, long.replace(" ", ""), "  ".join(rng.choice(words, 700)), "a" * 3000, "ab" * 2001, " " * 2500,
        "\n" * 1500, "\x00\x01" * 700, "😀🧵" * 600, "日本語" * 500, "é́" * 900, "".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 4000)), "=" * 1000 + "-" * 1000,
        "".join(chr(c) for c in rng.integers(0x4E00, 0x9FFF, 1500)), long + "x" * 5000 + long, "the cat " * 2500,
    ]


@pytest.mark.parametrize("chunk,overlap", [(64, 32), (200, 40), (1000, 64)])
def test_spliced_chunks_give_the_count_of_the_whole_text(spark, chunk, overlap):
    texts = odd_texts()
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id bigint, text string")
    got = {r.doc_id: r for r in token_counts.count_tokens(docs, chunk=chunk, overlap=overlap, limit=500).collect()}
    assert len(got) == len(texts)
    for i, t in enumerate(texts):
        assert got[i].n_tokens == plain(t), (i, t and t[:40])
        assert got[i].n_bytes == len((t or "").encode()) and got[i].over_limit == (plain(t) > 500)


def test_overlaps_without_a_common_piece_are_widened(spark):
    """A run of one letter is encoded from its beginning: chunks that begin elsewhere may never agree."""
    cut = token_counts._cut(spark.createDataFrame([("d", "a" * 1003)], "digest string, text string"), 100, 32)
    parts = token_counts._encoded(cut, "piece_bpe_32k.model", 32).collect()
    heads = {p.chunk: set(p.head) for p in parts}
    assert any(not set(p.tail) & heads[p.chunk + 1] for p in parts if p.chunk + 1 in heads)
    docs = spark.createDataFrame([(1, "a" * 1003)], "doc_id bigint, text string")
    assert token_counts.count_tokens(docs, chunk=100, overlap=32).first().n_tokens == plain("a" * 1003)


def test_repeated_rows_null_ids_and_clashing_columns(spark):
    texts = ["word " * 200, "word " * 200, "other " * 150, None]
    docs = spark.createDataFrame([(i if i else None, t) for i, t in enumerate(texts)], "doc_id bigint, text string").withColumns({c: F.lit(1) for c in ("digest", "chunk", "n", "id", "a.b")})
    docs = docs.unionByName(docs)
    got = token_counts.count_tokens(docs, chunk=100, overlap=32).toPandas()
    assert len(got) == 8 and got["doc_id"].isna().sum() == 2
    assert sorted(got["n_tokens"]) == sorted(2 * [plain(t) for t in texts])
    named = docs.select(F.col("doc_id").alias("x.y"), F.col("text").alias("t x"))
    assert token_counts.count_tokens(named, id_col="x.y", text_col="t x").count() == 8


def test_whole_table(spark, sf):
    got = QUERIES["op12_token_counts"](spark, sf).toPandas()
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").toPandas()
    expected = {d: plain(t) for d, t in zip(docs["doc_id"], docs["text"], strict=True)}
    assert len(got) == len(docs) and dict(zip(got["doc_id"], got["n_tokens"], strict=True)) == expected
    assert (got["over_limit"] == (got["n_tokens"] > 4096)).all()
