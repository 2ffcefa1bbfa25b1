"""Hard negatives against SQL and plain versions; the bounds leave out candidates where anchors lie close together."""

import sys
from pathlib import Path

import duckdb
import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

from check_oracle import compare  # noqa: E402

from cohortlens.llm import negatives  # noqa: E402
from cohortlens.llm.queries import ORACLES, QUERIES  # noqa: E402

NAME = "op13_hard_negatives"


def both(spark, path, table):
    pq.write_table(table, path / "embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{path}/embeddings.parquet')")
    return compare(QUERIES[NAME](spark, str(path)), con, ORACLES[NAME])


def embeddings(n=900, clusters=4, width=6, seed=1):
    rng = np.random.default_rng(seed)
    label = rng.integers(0, clusters, n)
    v = rng.normal(size=(clusters, width))[label] + 0.3 * rng.normal(size=(n, width))
    return list(range(-100, n - 100)), [list(map(float, x)) for x in v], [int(x) for x in label]


def as_table(ids, vectors, label, **extra):
    return pa.table({"vec_id": pa.array(ids, pa.int64()), "embedding": pa.array(vectors, pa.list_(pa.float64())), "label": pa.array(label, pa.int32()), **extra})


@pytest.mark.parametrize("anchors,candidates", [(256, 8192), (5, 100)])
def test_sql_in_one_and_in_many_blocks(spark, tmp_path, monkeypatch, anchors, candidates):
    monkeypatch.setattr(negatives, "ANCHORS", anchors)
    monkeypatch.setattr(negatives, "CANDIDATES", candidates)
    ids, v, label = embeddings()
    v[0] = v[50] = v[100]
    v[200:400] = [v[150]] * 200  # a vector that many rows share
    assert both(spark, tmp_path, as_table(ids, v, label)) == ""


def test_odd_rows(spark, tmp_path):
    ids, v, label = embeddings(400)
    v[7], v[8], v[9], v[10], v[11] = None, [1.0, None] + [0.0] * 4, [float("nan")] * 6, [float("-inf")] * 6, [0.0] * 6
    label[20], label[100] = None, None
    label[150] = 77  # the only row of its label
    ids[30], ids[31] = 0, 0  # one id on rows that differ
    extra = {c: pa.array([1] * 400) for c in ("v", "mark", "block", "part", "place", "a.b")}
    t = as_table(ids, v, label, **extra)
    assert both(spark, tmp_path, pa.concat_tables([t, t.slice(90, 30)])) == ""


@pytest.mark.parametrize("rows", [0, 1, 30])
def test_empty_and_small_tables(spark, tmp_path, rows):
    t = as_table(*embeddings(400)).slice(100 if rows < 30 else 101, rows)  # one row: an anchor alone; 30 rows: no anchor
    pq.write_table(t, tmp_path / "embeddings.parquet")
    assert QUERIES[NAME](spark, str(tmp_path)).count() == 0


def test_bounds_hold_and_leave_out_most_of_a_clustered_table():
    rng = np.random.default_rng(2)
    anchors = np.floor(256 * (np.array([1.0, 0, 0, 0]) + 0.02 * rng.normal(size=(40, 4)))).astype(np.int64)
    x = np.floor(256 * rng.normal(size=(3000, 4))).astype(np.int64)
    order, parent, edge = negatives.spanning_tree(anchors)
    assert sorted(order) == list(range(40)) and (np.array([list(order).index(p) for p in parent[order[1:]]]) < np.arange(1, 40)).all()
    exact, scored = anchors @ x.T, 0

    def wanted(a, low, high):
        assert (low <= exact[a]).all() and (exact[a] <= high).all()
        return (high >= 90_000) & (low <= 110_000)

    for a, at, scores in negatives.walk(negatives.Scorer(x, anchors), anchors, order, parent, edge, wanted):
        assert (scores == exact[a, at]).all()
        assert set(np.flatnonzero((exact[a] >= 90_000) & (exact[a] <= 110_000))) <= set(at)
        scored += len(at)
    assert scored < 0.35 * exact.size


def test_large_components_are_summed_as_integers():
    x = np.array([[2**31, 1], [2**31, -1]], np.int64)
    assert negatives.Scorer(x, x)(x[0]).tolist() == [2**62 + 1, 2**62 - 1]
