"""Operators against plain versions: token files, packing, near copies, reply trees, archives, languages, toxicity, pipeline."""

import collections
import functools
import io
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from cohortlens.llm import bitpack, chat, jaccard, language, mixing, packing, toxicity, tokens, topk, warc
from cohortlens.llm.graph import components
from cohortlens.llm.shingles import shingle_sets

public_tokenizers = pytest.importorskip("public_tokenizers")
TEXT = st.text(st.sampled_from(list("abAB'.,!?019 \n\t  éÉßıİ  ́#<|>ſǅ中")), max_size=60)


@functools.cache
def plain(vocab):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(public_tokenizers.path(vocab))


def plain_ids(vocab, text):
    return plain(vocab).encode(text, add_special_tokens=False).ids


@pytest.mark.parametrize("vocab", ["byte_bpe_50k.json", "word_bpe_49k.json"])
def test_remembered_pieces_give_the_ids_of_the_whole_text(vocab):
    enc = tokens.encoder(vocab)

    @settings(max_examples=300, deadline=None)
    @given(TEXT)
    def check(text):
        assert enc.ids(text).tolist() == plain_ids(vocab, text)

    check()
    for text in ["The idiot, it's\nNew. line  two", "<|endoftext|> a <|startoftext|>b", "a <|endoftext|> b", "x<|ENDofTEXT|>y  z", "<|endoftext|", "", " a", "a ", "\n", "x\n\ny z\tq", "a.\nB c!\nd"]:
        assert enc.ids(text).tolist() == plain_ids(vocab, text)


@settings(max_examples=100, deadline=None)
@given(st.integers(1, 32), st.integers(0, 300), st.integers(0, 200), st.integers(0, 100))
def test_bit_packing(width, n, start, run):
    ids = np.random.default_rng(n).integers(0, 1 << width, n).astype(np.uint32)
    data = bitpack.pack(ids, width)
    assert len(data) == -(-n // 64) * width * 8
    start = min(start, n)
    run = min(run, n - start)
    assert (bitpack.unpack(data, run, width, start) == ids[start : start + run]).all()


def test_segments_give_any_run_of_ids():
    ids = np.random.default_rng(1).integers(0, 50257, 200_000).astype(np.uint32)
    data = b"\n".join([bitpack.segment([7, None], [150_000, 50_000], ids, 16)] * 2) + b"\n"
    found = list(bitpack.segments(data))
    assert len(found) == 2 and found[1].doc_ids[0] == 7 and found[1].lengths.tolist() == [150_000, 50_000]
    assert (found[1].ids(65_000, 70_000) == ids[65_000:135_000]).all()


def first_fit_decreasing(lengths, capacity):
    bins = []
    for x in sorted(lengths, reverse=True):
        for i, b in enumerate(bins):
            if b + x <= capacity:
                bins[i] += x
                break
        else:
            bins.append(x)
    return len(bins)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 40), max_size=60))
def test_plan_places_every_piece_once(lengths):
    places, bins = packing.plan(collections.Counter(lengths), 40)
    load, ranks = collections.defaultdict(list), collections.defaultdict(set)
    for length, rank, count, first, offset in places.tolist():
        for i in range(count):
            assert rank + i not in ranks[length]
            ranks[length].add(rank + i)
            load[first + i].append((offset, length))
    assert {k: len(v) for k, v in ranks.items()} == dict(collections.Counter(lengths))
    assert all(v == set(range(len(v))) for v in ranks.values())
    for parts in load.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 40
    assert len(load) == bins <= max(first_fit_decreasing(lengths, 40), 0)


def least_bins(lengths, capacity):
    lengths, best = sorted(lengths, reverse=True), [len(lengths)]

    def go(i, bins):
        if len(bins) >= best[0]:
            return
        if i == len(lengths):
            best[0] = len(bins)
            return
        for j in range(len(bins)):
            if bins[j] + lengths[i] <= capacity and bins[j] not in bins[:j]:
                go(i + 1, bins[:j] + [bins[j] + lengths[i]] + bins[j + 1 :])
        go(i + 1, [*bins, lengths[i]])

    go(0, [])
    return best[0]


@settings(max_examples=150, deadline=None)
@given(st.lists(st.integers(1, 20), min_size=1, max_size=9))
def test_reduction_keeps_the_least_number(lengths):
    p = packing._Plan(collections.Counter(lengths), 20)
    p.reduce()
    rest = [k for k, n in p.left.items() for _ in range(n)]
    assert p.bins + (least_bins(rest, 20) if rest else 0) == least_bins(lengths, 20)


def brute_components(texts, k, share):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    label = list(range(len(texts)))
    for _ in texts:
        for i, a in enumerate(sets):
            for j, b in enumerate(sets[:i]):
                if a and b and 100 * len(a & b) >= share * len(a | b):
                    label[i] = label[j] = min(label[i], label[j])
    return [len(s) for s in sets], label


def test_near_copies(spark):
    rng = np.random.default_rng(2)
    texts = [None, "", "a b", "A B", "a b c", "x"]
    for n in (8, 40, 200):
        base = [f"w{rng.integers(500)}" for _ in range(n)]
        for changes in [0, 0, 1, 1, 2, 3, 5, 8, 12]:
            own = list(base)
            for i in rng.integers(n, size=changes):
                own[i] = f"z{rng.integers(10_000)}"
            texts.append(" ".join(own))
    passage = " ".join(f"p{i}" for i in range(40))
    texts += [f"{passage} " + " ".join(f"q{rng.integers(9999)}" for _ in range(n)) for n in (3, 3, 4, 60, 80, 3, 2)]
    chain = [f"c{i}" for i in range(120)]
    for i in range(12):
        texts.append(" ".join(chain))
        chain[i * 8] = f"d{i}"
    sizes, label = brute_components(texts, 4, 85)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(5)
    out = jaccard.near_copies(docs).toPandas().sort_values("doc_id")
    assert out["n_shingles"].tolist() == sizes
    assert out["component_id"].tolist() == label
    kept = jaccard.one_of_each(docs).toPandas()["doc_id"].sort_values().tolist()
    assert kept == [i for i in range(len(texts)) if label[i] == i]


@pytest.mark.parametrize("many", [2])
def test_many_changed_copies_of_one_text(spark, monkeypatch, many):
    """Copies that are linked with few others only: links that no centre has are found by what the copies changed."""
    monkeypatch.setattr(jaccard, "MANY", many)
    rng = np.random.default_rng(5)
    base = [f"w{i}" for i in range(70)]
    changed = [*base[:30], *(f"v{i}" for i in range(8)), *base[38:]]
    texts = []
    for i in range(150):
        own = list(base if i % 3 else changed)
        for at in rng.choice(14, rng.integers(2, 6), replace=False):
            own[int(at) * 5] = f"z{rng.integers(3)}"
        texts.append(" ".join(own[: len(own) - int(rng.integers(3))]))
    sizes, label = brute_components(texts, 4, 85)
    assert 20 < len(set(label)) < 140 and len({x for x in label if label.count(x) > 1}) > 5
    out = jaccard.near_copies(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)).toPandas().sort_values("doc_id")
    assert out["n_shingles"].tolist() == sizes
    assert out["component_id"].tolist() == label


@settings(max_examples=100, deadline=None)
@given(st.lists(st.one_of(st.none(), st.text(st.sampled_from(list("aAbB \n\té")), max_size=30)), max_size=5))
def test_shingles_equal_where_words_are(texts):
    plain = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub(r"[A-Z]", lambda m: m[0].lower(), t or ""))
        plain.append({tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else {tuple(w)} if w else set())
    ours = shingle_sets(texts, 3)
    assert [len(s) for s in ours] == [len(p) for p in plain]
    for a in range(len(texts)):
        for b in range(a):
            assert len(np.intersect1d(ours[a], ours[b])) == len(plain[a] & plain[b])


def test_components(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (101, 100), (7, 7), (200, 100)]
    out = components(spark.createDataFrame(edges, "a long, b long")).toPandas()
    assert dict(zip(out["node"], out["component"], strict=True)) == {i: 0 for i in range(41)} | {100: 100, 101: 100, 200: 100}


def test_reply_tree(spark):
    rows = [
        ("t", 1, None, "user", "root", 0.0), ("t", 2, 1, "assistant", "low", 1.0), ("t", 3, 1, "assistant", "high", 5.0), ("t", 4, 3, "user", "more", 1.0),
        ("t", 5, 3, "user", "other", 3.0), ("u", 1, 99, "user", "lost parent", None), ("v", 1, 2, "user", "ring", 0.0), ("v", 2, 1, "user", "ring", 0.0), ("v", 3, 1, "user", "below", 0.0),
    ] + [("w", i, i - 1 if i else None, "user", str(i), 0.0) for i in range(70)]
    messages = spark.createDataFrame(rows, "tree string, node long, parent long, role string, text string, score double")
    out = chat.format_chats(messages, 2).withColumn("turns", chat.read_turns(F.col("formatted"))).orderBy("tree", "branch").collect()
    assert [(r.tree, r.leaf, [t.text for t in r.turns]) for r in out] == [
        ("t", 5, ["root", "high", "other"]), ("t", 4, ["root", "high", "more"]), ("u", 1, ["lost parent"]), ("w", 69, [str(i) for i in range(70)]),
    ]


def test_water_filling_clamps_and_shares_the_rest(spark):
    sources = spark.createDataFrame([(3.0, 10), (1.0, 1000), (2.0, 100), (3.0, 0)], "weight double, source_size long")
    out = {r.source_size: r.target for r in mixing.water_fill(sources, 1110, 1.5, 2).collect()}
    assert out == {10: 20.0, 100: 200.0, 0: 0.0, 1000: 1665.0 - 220}


def test_mix_comes_near_its_targets(spark):
    docs = spark.range(4000).select(
        F.col("id").alias("doc_id"), F.concat(F.lit("s"), (F.col("id") % 7 % 3).cast("string")).alias("source"), F.repeat(F.lit("w "), (F.col("id") % 50).cast("int")).alias("text"),
    )
    out = mixing.mix_sources(docs).toPandas()
    for _, x in out.assign(source=[r["source"] for r in out["row"]]).groupby("source"):
        assert abs((x["size"] * x["copies"]).sum() - x["target"].iloc[0]) <= 50
        assert x["copies"].max() <= 2


def test_top_k_of_wide_integers(spark):
    rng = np.random.default_rng(1)
    v = rng.integers(-(2**28), 2**28, (300, 7))
    rows = [(i, x.tolist()) for i, x in enumerate(v)]
    vectors = spark.createDataFrame(rows, "vec_id long, v array<long>")
    out = topk.top_k(vectors, vectors.filter("vec_id < 5").withColumnRenamed("vec_id", "query_id"), 4, lists=3).toPandas().sort_values(["query_id", "rank"])
    for q in range(5):
        score = v.astype(object) @ v[q].astype(object)
        best = sorted((i for i in range(300) if i != q), key=lambda i: (-score[i], i))[:4]
        assert out[out["query_id"] == q]["vec_id"].tolist() == best
        assert out[out["query_id"] == q]["score"].tolist() == [score[i] for i in best]


def arc(version, records):
    extra = "" if version == 1 else "200 - - 0 x.arc "
    block = f"{version} 0 org\n{warc.FIELDS[version]}\n".encode()
    out = f"filedesc://x.arc 0.0.0.0 19970101 text/plain {extra}{len(block)}\n".encode() + block + b"\n"
    for url, body in records:
        out += f"{url} 1.2.3.4 19970203040506 text/html {extra}{len(body)}\n".encode() + body + b"\n"
    return out


@pytest.mark.parametrize("version", [1, 2])
def test_arc_files_of_many_records(version):
    records = [("http://a/", b"HTTP/1.0 200 OK\r\n\r\nhello"), ("dns:a", b"a 1.2.3.4"), ("http://b/", b"\xff\n\nraw\n")]
    found = list(warc.arc_records(arc(version, records)))
    assert [(r["URL"], r["body"], r["truncated"]) for r in found] == [(u, b, False) for u, b in records]
    data = b"".join(warc.warc_record(r, "k", None) + b"\r\n\r\n" for r in found)
    back = list(warc.warc_records(io.BytesIO(data)))
    assert [b for _, b in back] == [b for _, b in records]
    assert [h["WARC-Type"] for h, _ in back] == ["response", "resource", "resource"]
    assert back[0][0]["WARC-Date"] == "1997-02-03T04:05:06Z" and len({h["WARC-Record-ID"] for h, _ in back}) == 3
    cut = list(warc.arc_records(arc(version, records)[:-4]))
    assert cut[-1]["truncated"] and len(cut) == 3
    assert list(warc.arc_records(b"nonsense")) == [] and list(warc.arc_records(b"")) == []


def test_subsequence_kernel_by_enumeration():
    from itertools import combinations

    def brute(s, t):
        def spans(w):
            out = collections.Counter()
            for c in combinations(range(len(w)), toxicity.LENGTH):
                out["".join(w[i] for i in c)] += toxicity.DECAY ** (c[-1] - c[0] + 1)
            return out

        a, b = spans(s), spans(t)
        return sum(a[x] * b[x] for x in a)

    pairs = [("idiot", "idiot"), ("idiot", "ixdixot"), ("abcabc", "aabbcc"), ("ab", "abc"), ("loweischaft", "lowei")]
    ours = toxicity.subsequence_kernel(toxicity._codes([a for a, _ in pairs])[0], toxicity._codes([b for _, b in pairs])[0])
    assert np.allclose(ours, [brute(a, b) for a, b in pairs], rtol=1e-5)


def test_toxicity_finds_spread_insults(spark):
    rng = np.random.default_rng(4)
    calm, bad = ["".join(rng.choice(list("aeioulmnrst"), 6)) for _ in range(400)], ["idiot", "scumbag", "pathetic"]
    rows, labels = [], []
    for i in range(600):
        w = list(rng.choice(calm, 30))
        if i % 3 == 0:
            w[int(rng.integers(30))] = bad[i % 9 // 3]
        rows.append((i, " ".join(w[:15]) + ". " + " ".join(w[15:]) + "."))
        labels.append((i, int(i % 3 == 0)))
    rows += [(1000, "some iddiot here"), (1001, "i d i o t"), (1002, "a path-etic text"), (1003, ""), (1004, None), (1005, " ".join(calm[:50]))]
    out = toxicity.score_toxicity(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, toxic int")).toPandas()
    got = dict(zip(out["doc_id"], out["predicted"], strict=True))
    held = out[out["held_out"] & (out["doc_id"] < 600)]
    assert len(held) > 60 and (held["predicted"] == (held["doc_id"] % 3 == 0)).mean() > 0.97
    assert [got[i] for i in range(1000, 1006)] == [1, 1, 1, 0, 0, 0]
    assert out["score"].between(0, 1).all()
    assert (out["held_out"] == [zlib.crc32(str(i).encode()) % 5 == 0 for i in out["doc_id"]]).all()


def test_languages(spark):
    rng = np.random.default_rng(6)
    speech = {"de": "der die und nicht schein keit ung", "en": "the and that with tion ing", "fr": "les que dans est eau tion"}
    rows = []
    for i in range(300):
        lang = list(speech)[i % 3]
        rows.append((i, " ".join(rng.choice(speech[lang].split(), 40)), lang if i % 10 else "xx" if i % 20 else None, f"host{i % 3}.org"))
    rows += [(900, "und", "de", "host0.org"), (901, "", "de", "host0.org"), (902, None, None, None), (903, "中文字符" * 60, None, "h"), (904, "qu", "en", "h")]
    out = language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).toPandas().set_index("doc_id")
    assert all(out.loc[i, "language"] == list(speech)[i % 3] and out.loc[i, "kept"] for i in range(300))
    assert out.loc[900, "kept"] and out.loc[900, "language"] == "de"
    assert out.loc[[901, 902, 903, 904], "reason"].tolist() == ["no_text", "no_text", "unknown", "no_text"]
    page = spark.createDataFrame([('<!DOCTYPE html><HTML dir=ltr lang="de-AT">',), ("<p lang=fr>",)], "html string")
    assert [r[0] for r in page.select(language.declared_in_page(F.col("html"))).collect()] == ["de", ""]


def test_pipeline_by_hand(spark, sf):
    """Every stage against a plain reading of the same rows."""
    import corpus_pipeline as p

    from cohortlens.llm.common import table, written

    docs = table(spark, sf, "documents")
    kept = []
    for name, stage in p.STAGES[:-1]:
        docs = written(stage(spark, docs, sf), name)
        assert docs.columns == table(spark, sf, "documents").columns
        kept.append(docs.toPandas())
    first = table(spark, sf, "documents").toPandas().set_index("doc_id")
    assert kept[0]["text"].tolist() == first.loc[kept[0]["doc_id"], "text"].tolist() and len(kept[0]) >= 0.98 * len(first)
    assert set(kept[1]["doc_id"]) <= set(kept[0]["doc_id"])
    texts = kept[1].sort_values("doc_id")
    _, label = brute_components(texts["text"].tolist(), 5, 80)
    assert sorted(kept[2]["doc_id"]) == texts["doc_id"].iloc[sorted(set(label))].tolist()
    mixed = {r.row.doc_id: r.copies for r in mixing.mix_sources(spark.createDataFrame(kept[2])).collect()}
    assert collections.Counter(kept[3]["doc_id"]) == collections.Counter({k: n for k, n in mixed.items() if n})
    out = p.run(spark, sf).toPandas()
    want = collections.Counter()
    for key, text in zip(kept[3]["doc_id"], kept[3]["text"], strict=True):
        ids = np.array([*plain_ids("word_bpe_49k.json", text), 1], "<u4")
        for i, s in enumerate(range(0, len(ids), 4096)):
            want[key, i, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    assert collections.Counter(map(tuple, out[["doc_id", "piece", "start", "length", "ids_crc32"]].to_numpy().tolist())) == want
    for _, x in out.sort_values("offset").groupby("sequence_id"):
        assert (x["offset"] == x["length"].cumsum() - x["length"]).all() and x["length"].sum() <= 4096
    assert pd.Series(out["sequence_id"]).nunique() <= -(-out["length"].sum() // 4096) * 1.02 + 1
