"""Operators do the whole job: every declared language, evidence of addresses, whole words, whole sequences."""

import collections
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from cohortlens.llm import bitpack, language, packing, tokens, toxicity
from cohortlens.llm.common import table


def test_rare_languages_are_modelled_at_any_size(spark):
    rng = np.random.default_rng(8)
    codes = [f"{a}{b}" for a in "abcdefg" for b in "klmnopqrst"]
    rows = []
    for lang in codes:
        words = ["".join(rng.choice(list("abcdefghijklmnopqrstuvwxyz"), 7)) for _ in range(12)]
        rows += [(len(rows) + i, " ".join(rng.choice(words, 30)), lang, "s") for i in range(12)]
    common = spark.range(60_000).select(
        (F.col("id") + 10_000).alias("doc_id"), F.concat(F.lit("the and that "), F.md5(F.col("id").cast("string"))).alias("text"), F.lit("zz").alias("lang"), F.lit("s").alias("source"),
    )
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")
    out = language.identify(docs.unionByName(common).repartition(4)).filter("doc_id < 10000").toPandas()
    assert len(out) == 840 and (out["language"] == out["declared"]).all() and out["kept"].mean() > 0.99


def test_a_language_left_out_is_unknown(spark):
    docs = table(spark, "/root/testdata/sf0.01", "documents")
    for left in ("es", "en"):
        given = docs.withColumn("lang", F.when(F.col("lang") != left, F.col("lang")))
        out = language.identify(given).toPandas().set_index("doc_id")
        truth = docs.select("doc_id", "lang").toPandas().set_index("doc_id")["lang"].reindex(out.index)
        long = out["n_trigrams"] > 200
        assert (out.loc[long & (truth == left), "reason"] == "unknown").mean() > 0.97
        assert out.loc[truth != left, "kept"].mean() > 0.97


def test_sequences_hold_the_ids_of_all_documents(spark):
    pytest.importorskip("public_tokenizers")
    docs = table(spark, "/root/testdata/sf0.001", "documents")
    texts = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    rows = [*texts, (7, "twice"), (7, "twice"), (None, None), (None, "no id")]
    sequences = packing.pack_documents(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), capacity=512)
    got, encode = [], tokens.encoder("word_bpe_49k.json").ids
    for r in sequences.collect():
        assert len(r.ids) == sum(r.lengths) <= 512
        at = 0
        for key, piece, n in zip(r.doc_ids, r.pieces, r.lengths, strict=True):
            got.append((str(key), piece, tuple(r.ids[at : at + n])))
            at += n
    want = []
    for key, text in rows:
        ids = [*encode(text).tolist(), 1]
        want += [(str(key), i, tuple(ids[s : s + 512])) for i, s in enumerate(range(0, len(ids), 512))]
    assert collections.Counter(got) == collections.Counter(want)
    back = packing.piece_digests(sequences, 512).toPandas()
    assert len(back) == len(want) and back["length"].sum() == sum(len(x[2]) for x in want)
    assert (back["start"] == back["piece"] * 512).all()


def test_sequences_are_stored_as_bytes(spark):
    """Spark handles no id one by one: two bytes an id are stored, and digests of both forms agree."""
    pytest.importorskip("public_tokenizers")
    docs = spark.createDataFrame([(1, "a b c " * 50), (2, None), (3, "x"), (3, "x")], "doc_id long, text string")
    stored = packing.pack_sequences(docs, capacity=64)
    assert dict(stored.dtypes)["ids"] == "binary" and all(len(r.ids) == 2 * sum(r.lengths) for r in stored.collect())
    listed = [packing.piece_digests(x, 64).drop("sequence_id", "offset").collect() for x in (stored, packing.pack_documents(docs, capacity=64))]
    assert sorted(listed[0]) == sorted(listed[1]) and {r.doc_id for r in listed[0]} == {1, 2, 3}


def test_wrong_places_are_an_error(spark, monkeypatch):
    pytest.importorskip("public_tokenizers")
    right = packing.plan

    def shifted(counts, capacity):
        places, bins = right(counts, capacity)
        return places + [0, 0, 0, 0, 1], bins

    monkeypatch.setattr(packing, "plan", shifted)
    docs = spark.createDataFrame([(1, "some words"), (2, "more")], "doc_id long, text string")
    with pytest.raises(Exception, match="without gaps"):
        packing.pack_documents(docs)


def test_near_copy_stage_takes_five_words_and_four_fifths(spark):
    import corpus_pipeline as p

    text = " ".join(f"w{i}" for i in range(104))  # 100 shingles of five words
    longer = f"{text} " + " ".join(f"x{i}" for i in range(20))  # 100 of 120 are shared
    other = f"{text} " + " ".join(f"y{i}" for i in range(26))  # 100 of 126
    docs = spark.createDataFrame([(1, text), (2, longer), (3, other)], "doc_id long, text string")
    assert sorted(r.doc_id for r in dict(p.STAGES)["near_copies"](spark, docs, "").collect()) == [1, 3]


def test_near_words_do_not_depend_on_closing_signs_or_memory():
    marks = toxicity.Landmarks(["moron", "idiot"])
    text = "an idiot. you m-o-r-o-n!!! more text. what an idiot?!"
    fresh, warmed = toxicity.Words(marks), toxicity.Words(marks)
    warmed.sentences(["m-o-r-o-n! moron idiot m-o-r-o-n"])
    a, b = fresh.sentences([text])[0], warmed.sentences([text])[0]
    assert len(a) == len(b) == 3 and all((x == y).all() for x, y in zip(a, b, strict=True))
    assert a[1][0] > 0.99 and a[2][1] > 0.99


def test_a_dotted_suffix_changes_an_undecided_posterior(spark):
    rng = np.random.default_rng(3)
    words = {"de": "der die und nicht schein keit".split(), "fr": "les que dans est eau tion".split()}
    rows = [(i, " ".join(rng.choice(words[x], 40)), x, f"h{i % 20}.{x}") for i in range(200) for x in [("de", "fr")[i % 2]]]
    rows += [(900, "zqx", None, "new.de"), (901, "zqx", None, "new.fr"), (902, "zqx", None, "newde")]
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert out.loc[[900, 901], "language"].tolist() == ["de", "fr"] and (out.loc[[900, 901], "posterior"] > 0.9).all()
    assert out.loc[902, "posterior"] < 0.6


def test_token_files_give_the_ids_of_all_texts(spark, tmp_path, monkeypatch):
    """Places, numbers and digests against plain ids; several files, special tokens, huge and empty texts, null and repeated ids."""
    from tokenizers import Tokenizer

    public_tokenizers = pytest.importorskip("public_tokenizers")
    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    monkeypatch.setattr(bitpack, "SEGMENT", 2000)
    rng = np.random.default_rng(8)
    texts = [" ".join(rng.choice(["alpha", "be ta", "<|endoftext|>", "ß\n", "中", "12"], n)) for n in rng.integers(0, 300, 60)] + [None, "", "word " * 9000]
    rows = [(i * 3 % 63 if i % 9 else None, t) for i, t in enumerate(texts)] + [(5, "same"), (5, "same")]
    docs = spark.createDataFrame(rows, "doc_id bigint, text string").repartition(4)
    path = bitpack.write_ids(docs, "byte_bpe_50k.json", 0)
    assert spark.read.format("binaryFile").load(path).count() > 1
    got, start = bitpack.read_ids(spark, path).toPandas(), 0
    assert len(got) == len(rows)
    plain = {}
    for key, text in rows:
        ids = np.array([*tok.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        plain.setdefault(key, []).append((len(ids), zlib.crc32(ids.tobytes())))
    for r in got.sort_values("start").itertuples():
        key = None if np.isnan(r.doc_id) else int(r.doc_id)
        assert r.start == start
        plain[key].remove((r.n_tokens, r.ids_crc32))
        start += r.n_tokens
    order = got.sort_values("start")["doc_id"].dropna().tolist()
    assert order == sorted(order) and not any(plain.values())
