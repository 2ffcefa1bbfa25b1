import numpy as np
import pandas as pd
import pytest

from cohortlens.operators import rankcorr


def _rho(a, b, w):
    def rank(v):
        return np.array([w[v < x].sum() + (w[v == x].sum() + 1) / 2 for x in v])

    ra, rb = (r - (w * r).sum() / w.sum() for r in (rank(a), rank(b)))
    spread = np.sqrt((w * ra * ra).sum() * (w * rb * rb).sum())
    return (w * ra * rb).sum() / spread if spread > 1e-9 else None


@pytest.fixture(scope="module")
def rows():
    rng, n = np.random.default_rng(1), 900
    pdf = pd.DataFrame({"g": rng.choice(["x", "y", None], n), "y": np.round(rng.normal(size=n), 2), "p": rng.normal(size=n)})
    pdf.loc[::3, "y"] = 0.5  # a hot value
    pdf["few"], pdf["flat"] = rng.integers(0, 9, n).astype(float), 1.0
    pdf["w0"], pdf["w1"], pdf["w2"] = rng.poisson(1, n), 100 * rng.poisson(1, n), 0
    pdf.loc[5, "p"], pdf.loc[7, "y"] = np.inf, np.nan
    return pdf


@pytest.mark.parametrize("size", [40, 1 << 17])
@pytest.mark.parametrize("pair", [("y", "p"), ("y", "few"), ("few", "y"), ("y", "flat")])
def test_weighted_correlations_on_any_number_of_ranges(spark, monkeypatch, rows, size, pair):
    monkeypatch.setattr(rankcorr, "RANGE_ROWS", size)
    monkeypatch.setattr(rankcorr, "BLOCK_ROWS", 100)
    df, (a, b) = spark.createDataFrame(rows), pair
    plain = {r["g"]: r for r in rankcorr.spearman(df, ["g"], a, b).collect()}
    lanes = {(r["g"], r["lane"]): r for r in rankcorr.spearman_lanes(df, ["g"], a, b, ["w0", "w1", "w2"]).collect()}
    assert set(plain) == {"x", "y"}
    for g in ("x", "y"):
        own = rows[(rows["g"] == g) & np.isfinite(rows[a]) & np.isfinite(rows[b])]
        for lane, w in ((None, np.ones(len(own))), (0, own["w0"].to_numpy()), (1, own["w1"].to_numpy())):
            got, want = plain[g] if lane is None else lanes[g, lane], _rho(own[a].to_numpy(), own[b].to_numpy(), w)
            assert got["n"] == w.sum() and got["rho"] == (None if want is None else pytest.approx(want, abs=1e-12))
        assert lanes[g, 2]["n"] == 0 and lanes[g, 2]["rho"] is None


def test_rows_travel_as_blocks(spark, tmp_path):
    """A correlation moves arrays: a handful of records for a hundred thousand rows, not one each."""
    df = spark.range(100_000).selectExpr("id % 2 AS g", "rand(1) AS y", "rand(2) AS p")
    blocks = rankcorr._blocks(df.selectExpr("g AS _k", "y AS _a", "p AS _b"), 0)
    found = blocks.selectExpr("count(*) AS n", "sum(_n) AS rows", "max(length(a)) AS bytes").first()
    assert found["rows"] == 100_000 and found["n"] <= 2 * df.rdd.getNumPartitions() and found["bytes"] <= 8 * rankcorr.BLOCK_ROWS
