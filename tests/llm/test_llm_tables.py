"""Queries with SQL against DuckDB on a small table of odd rows; repeated rows, empty tables and clashing columns apart."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check_oracle import TABLES, compare  # noqa: E402

from cohortlens.llm.queries import ORACLES, QUERIES  # noqa: E402

_rng = np.random.default_rng(3)
_VOCAB = ["".join(_rng.choice(list("abcdefghij"), 5)) for _ in range(300)]


def words(n, seed=0):
    return list(np.random.default_rng(seed).choice(_VOCAB, n))


def odd_texts():
    long = words(4000, 1)
    line = "Shared Line of the  host number one"
    texts = [
        "", None, " \t\n ", "one", "one two three", " ".join(words(9, 2)), " ".join(words(12, 3)), " ".join(long), " ".join(long[:2000] + long[:2000]),
        "\n".join(["same line here now"] * 30), "a b c d e " * 40, "# * $ % & | < > x " * 5, "Äöü ß éè ñ z " * 8, "x" * 5000, "\x0b\x0c\r\n",
        "tail blank here ", " head blank here", "two  blanks", "<|endoftext|> it's\n\nnew\tline ́ İ", "end\nof\nlines\n",
    ]
    texts += [f"{line if i % 2 else line.upper()}\n{' '.join(words(20, 100 + i))}" for i in range(60)]
    texts += [f"{line}\n{' '.join(words(3, 200 + i))}" for i in range(5)]
    return texts


def documents():
    texts = odd_texts()
    n = len(texts)
    source = ["h1" if i >= 20 else [None, "", "h2", "Ü", "a"][i % 5] for i in range(n)]
    return pa.table({
        "doc_id": pa.array(range(n), pa.int64()), "text": pa.array(texts), "lang": pa.array([[None, "en", "de", "EN-us", "??"][i % 5] for i in range(n)]),
        "source": pa.array(source), "n_chars": pa.array([len(t or "") for t in texts], pa.int64()), "size": pa.array([1] * n), "key": pa.array(["k"] * n),
        "row": pa.array([2.0] * n), "_id": pa.array(range(n)), "cls": pa.array([None] * n, pa.string()), "a.b": pa.array([0] * n),
    })


def pages():
    big = "<html>" + "payload " * 200
    html = ["", None, "small", "small", big, big, big, "\r\n\r\nWARC/1.1\r\n" + big, "ü" * 500, "ü" * 500, "ü" * 499]
    return pa.table({
        "page_id": pa.array([3, 5, 7, 8, 1, 20, 9, 11, 12, 13, 14], pa.int64()), "url": pa.array([None, "", "http://a b/c\n"] + ["http://x.org/"] * 8), "html": pa.array(html),
        "digest": pa.array([0] * 11), "key": pa.array([None] * 11, pa.string()),
    })


def conversations():
    rows = [
        (1, 0, "user", "hi <s>[INST]"), (1, 1, "assistant", "<\\s> \\ [\\/INST]</s>"), (1, 2, None, None), (1, 3, "assistant", ""), (2, 0, "assistant", "only"),
        (3, 0, "system", "x" * 50000), (3, 1, "</s>[INST]", "[INST"), (3, 1, "assistant", "again"), (3, 1, "assistant", "again"), (4, 0, "user", "INST]<"), (5, 0, "user", "\n\n"),
    ] + [(6, i, "user" if i % 2 else "assistant", f"turn {i}") for i in range(40)]
    c = list(zip(*rows, strict=True))
    return pa.table({
        "conv_id": pa.array(c[0], pa.int64()), "turn": pa.array(c[1], pa.int32()), "role": pa.array(c[2]), "text": pa.array(c[3]), "score": pa.array(["s"] * len(rows)), "node": pa.array([0] * len(rows)),
    })


def embeddings():
    rng = np.random.default_rng(5)
    v = [list(map(float, x)) for x in rng.normal(size=(320, 5))]
    v[10:60] = [v[0]] * 50
    v[61], v[62], v[63], v[64] = None, [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf")] + [0.0] * 4
    v[100:110] = [[0.0] * 5] * 10
    v[200] = v[201]
    return pa.table({"vec_id": pa.array(range(320), pa.int64()), "embedding": pa.array(v, pa.list_(pa.float64())), "v": pa.array([1] * 320), "list": pa.array([0] * 320), "label": pa.array([i % 3 for i in range(320)], pa.int32())})


def benchmark():
    return pa.table({"item_id": pa.array([0, 1, None], pa.int64()), "text": pa.array([" ".join(words(30, 1)), "Shared line", None])})


def write(path, **tables):
    for name, t in tables.items():
        pq.write_table(t, path / f"{name}.parquet")
    return str(path)


@pytest.fixture(scope="module")
def odd(tmp_path_factory):
    return write(
        tmp_path_factory.mktemp("odd"), documents=documents(), pages=pages(), conversations=conversations(), embeddings=embeddings(), benchmark=benchmark(),
        labels=pa.table({"doc_id": pa.array([0, 1, None], pa.int64()), "toxic": pa.array([0, 1, 1], pa.int64())}),
    )


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, odd, name):
    con = duckdb.connect()
    for t in TABLES:
        if (Path(odd) / f"{t}.parquet").exists():
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{odd}/{t}.parquet')")
    assert compare(QUERIES[name](spark, odd), con, ORACLES[name]) == ""


@pytest.mark.parametrize("name", sorted(QUERIES))
def test_empty_tables(spark, tmp_path, name):
    path = write(
        tmp_path, documents=documents()[:0], pages=pages()[:0], conversations=conversations()[:0], embeddings=embeddings()[:0], benchmark=benchmark()[:0],
        labels=pa.table({"doc_id": pa.array([], pa.int64()), "toxic": pa.array([], pa.int64())}),
    )
    assert QUERIES[name](spark, path).count() == (1 if name.startswith("op1_") else 0)


@pytest.mark.parametrize("name", sorted(q for q in QUERIES if not q.startswith(("op1_", "op2_", "op4_", "op11_", "op13_"))))
def test_repeated_rows_and_null_ids(spark, tmp_path, name):
    """Every row of the table has a result; rows that are the same have the same one where places don't matter."""
    t = documents()
    extra = t.slice(3, 5).set_column(0, "doc_id", pa.array([None] * 5, pa.int64()))
    both = pa.concat_tables([t, t.slice(0, 30), extra])
    path = write(tmp_path, documents=both, labels=pa.table({"doc_id": pa.array([0, 1, 1, None], pa.int64()), "toxic": pa.array([0, 1, None, 1], pa.int64())}))
    out = QUERIES[name](spark, path).toPandas()
    if name.startswith("op5_"):
        out = out[out["piece"] == 0]
    assert len(out) == both.num_rows
    assert out["doc_id"].isna().sum() == 5
    moving = {"start", "sequence_id", "offset"}
    same = out.drop(columns=[c for c in out.columns if c in moving]).dropna(subset=["doc_id"]).astype(str).drop_duplicates()
    assert len(same) == t.num_rows


def test_repeated_vectors_and_pages(spark, tmp_path):
    path = write(tmp_path, embeddings=pa.concat_tables([embeddings(), embeddings()]), pages=pa.concat_tables([pages(), pages()]))
    top = QUERIES["op2_top_k_search"](spark, path).toPandas()
    assert not top.duplicated(["query_id", "vec_id"]).any() and (top.groupby("query_id").size() == 10).all()
    out = QUERIES["op4_warc_archives"](spark, path).toPandas()
    assert len(out) == 22 and set(out[out["page_id"] == 20]["record_type"]) == {"response"}
