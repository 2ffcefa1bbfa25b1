import numpy as np
import pytest
from brute import spearman
from test_resample_folds import SCHEMA, oof_rows, weights

from cohortlens.operators import resample
from cohortlens.operators.rankcorr import _unpacked


def test_packed_weights_are_those_of_the_plan(spark, monkeypatch):
    monkeypatch.setattr(resample, "DRAW_BLOCK", 7)
    monkeypatch.setattr(resample, "SEGMENT", 6)
    rows = [(f"g{i}",) for i in range(23)]
    groups = resample.index_groups(spark.createDataFrame(rows, "group_id string"), "group_id", 5)
    want = np.zeros((9, 23), int)
    for r in resample.draw_plan(groups, 9, 5).collect():
        want[r["replicate"], r["slot"]] += 1
    got = np.zeros((9, 23), int)
    for r in resample.draw_weights(spark, 23, 9, 5, 3).collect():
        n = min(3, 23 - 3 * r["_q"])
        got[r["replicate"], 3 * r["_q"] : 3 * r["_q"] + n] += _unpacked(r["w"], n, 1)[:, 0]
    assert (got == want).all() and (got.sum(axis=1) == 23).all()


def test_a_group_that_is_not_drawn_spoils_no_replicate(spark):
    rows = [r if r[1] != "g3" else (*r[:6], float("inf"), r[7]) for r in oof_rows()]
    draws = resample.paired_bootstrap(spark.createDataFrame(rows, SCHEMA), ["module"], n_resamples=8, seed=3, spearman=False)
    mae = {r["replicate"]: r["metric_a"] for r in draws.filter("metric = 'mae'").collect()}
    plans = weights(rows, 8, 3)
    assert {r: np.isfinite(v) for r, v in mae.items()} == {r: plan["g3"] == 0 for r, plan in enumerate(plans)}
    assert len({plan["g3"] == 0 for plan in plans}) == 2


def test_increment_makes_all_draws(spark, sf):
    """With 20 draws no p could be below 2 / 21."""
    from cohortlens.plans.q_inference import i03

    p = [r["p_sign_tail"] for r in i03(spark, sf).collect()]
    assert min(p) == pytest.approx(2 / 5001, abs=1e-6)


def test_paired_spearman_makes_all_draws(spark, sf, monkeypatch):
    """Five draws said little: the query asks for as many as the analyses make."""
    from cohortlens.plans import q_inference

    asked = []
    monkeypatch.setattr(q_inference.resample, "paired_bootstrap", lambda rows, by, **given: asked.append(given))
    monkeypatch.setattr(q_inference.resample, "paired_summary", lambda draws, by: None)
    q_inference.i02b(spark, sf)
    assert asked == [{"n_resamples": 5000}]


def test_spearman_in_several_batches_of_replicates(spark, monkeypatch):
    df = spark.createDataFrame(oof_rows(), SCHEMA)
    monkeypatch.setattr(resample, "LANE_BYTES", 64 * 7)
    few = resample.paired_bootstrap(df, ["module"], n_resamples=7, seed=3, batch=3).filter("metric = 'spearman'").collect()
    one = resample.paired_bootstrap(df, ["module"], n_resamples=7, seed=3, batch=7).filter("metric = 'spearman'").collect()
    key = lambda r: r["replicate"]
    assert sorted(map(tuple, few), key=lambda t: t[2]) == sorted(map(tuple, one), key=lambda t: t[2]) and len(few) == 7
    plans = weights(oof_rows(), 7, 3)
    for r in sorted(few, key=key):
        rows = [x for x in oof_rows() for _ in range(plans[r["replicate"]][x[1]])]
        assert r["metric_a"] == pytest.approx(spearman([x[5] for x in rows], [x[6] for x in rows]), abs=1e-9)
