"""Lexical search against SQL on odd rows and in many segments, and the iterators against plain sums."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check_oracle import compare  # noqa: E402

from cohortlens.llm import lexical  # noqa: E402
from cohortlens.llm.queries import ORACLES, QUERIES  # noqa: E402

NAME = "op11_lexical_search"
_rng = np.random.default_rng(6)
_WORDS = ["".join(_rng.choice(list("abcdé中9"), 3)) for _ in range(120)]


def text(n, seed):
    """Words of very uneven frequency."""
    rng = np.random.default_rng(seed)
    return " ".join(_WORDS[min(119, int(i))] for i in rng.exponential(15, n))


def tables(docs, items):
    n = len(docs)
    return (
        pa.table({"doc_id": pa.array([d for d, _ in docs], pa.int64()), "text": pa.array([t for _, t in docs], pa.string()), "id": pa.array([1] * n), "n": pa.array([2] * n), "a.b": pa.array([""] * n)}),
        pa.table({"item_id": pa.array([d for d, _ in items], pa.int64()), "text": pa.array([t for _, t in items], pa.string()), "number": pa.array([0] * len(items)), "terms": pa.array([None] * len(items), pa.string())}),
    )


def both(spark, path, documents, benchmark):
    con = duckdb.connect()
    for name, t in (("documents", documents), ("benchmark", benchmark)):
        pq.write_table(t, path / f"{name}.parquet")
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}/{name}.parquet')")
    return compare(QUERIES[NAME](spark, str(path)), con, ORACLES[NAME])


def odd():
    docs = [(i, text(int(n), i)) for i, n in enumerate(np.random.default_rng(1).integers(1, 120, 400))]
    docs += [(1000, None), (1001, ""), (1002, "...--- \t\x00"), (None, text(30, 5)), (None, text(30, 5)), (2000, text(20_000, 9)), (7, text(30, 5)), (7, text(30, 5))]
    docs += [(3000 - i, "Zz ZZ zz QUEUE") for i in range(130)]  # ties beyond the 50th
    docs += [(4000, "ÀÉ àé İ \x7f_x{y}"), (4001, "a-b.c'd")]
    items = [(i, text(25, 500 + i)) for i in range(20)]
    items += [(100, "zz, zz!"), (101, "nowhere else"), (102, None), (103, ""), (104, "?!"), (1, items[1][1]), (1, "queue"), (None, "ÀÉ x"), (105, text(3000, 77))]
    return docs, items


@pytest.mark.parametrize("docs,step,terms", [(32_768, 2048, 1 << 18), (40, 16, 60)])
def test_sql_in_one_and_in_many_segments(spark, tmp_path, monkeypatch, docs, step, terms):
    monkeypatch.setattr(lexical, "DOCS", docs)
    monkeypatch.setattr(lexical, "STEP", step)
    monkeypatch.setattr(lexical, "TERMS", terms)
    assert both(spark, tmp_path, *tables(*odd())) == ""


@pytest.mark.parametrize("docs,items", [(0, 5), (5, 0), (0, 0)])
def test_empty_tables(spark, tmp_path, docs, items):
    d, b = tables(*odd())
    for name, t in (("documents", d[:docs]), ("benchmark", b[:items])):
        pq.write_table(t, tmp_path / f"{name}.parquet")
    assert QUERIES[NAME](spark, str(tmp_path)).count() == 0


def test_terms():
    assert lexical.terms_of("It's ÀB_c 1st\x00x\x7fy{Z}É".encode()) == [t.encode() for t in ("it", "s", "Àb", "c", "1st", "x", "y", "z", "É")]


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**6), st.integers(1, 400), st.integers(0, 9), st.integers(1, 12), st.integers(0, 400))
def test_iterators_give_the_highest_sums(seed, count, lists, k, above):
    rng = np.random.default_rng(seed)
    made, sums = [], np.zeros(count, np.int64)
    for _ in range(lists):
        docs = np.flatnonzero(rng.random(count) < rng.choice([0.005, 0.02, 0.3, 0.9]))
        if len(docs):
            values = rng.integers(1, rng.choice([3, 100]), len(docs))
            made.append((docs, values, int(values.max())))
            sums[docs] += values
    made.sort(key=lambda x: len(x[0]))
    step, lexical.STEP = lexical.STEP, 32
    try:
        docs, scores = lexical.best(made, count, k, above)
    finally:
        lexical.STEP = step
    expected = [int(d) for d in np.lexsort((np.arange(count), -sums)) if sums[d] > above][:k]
    assert docs.tolist() == expected and scores.tolist() == sums[expected].tolist()
