"""Products of blocks against plain sums."""

import numpy as np
import pytest

from cohortlens.operators import blocks


@pytest.mark.parametrize("sizes", [(512, 512, 8192), (3, 4, 5)])
def test_every_sample_meets_every_set(spark, monkeypatch, sizes):
    for name, n in zip(("SAMPLES", "SETS", "GENES"), sizes, strict=True):
        monkeypatch.setattr(blocks, name, n)
    rng = np.random.default_rng(3)
    x = {(f"s{i}", f"g{j}"): float(rng.normal()) for i in range(11) for j in range(17) if rng.random() < 0.4}
    sets = {(m, c): {f"g{j}": float(rng.normal()) for j in {0, *rng.integers(0, 20, 4).tolist()}} for m in ("A", None) for c in range(7)}
    values = spark.createDataFrame([(s, g, v) for (s, g), v in x.items()] + [("s1", "g0", None), ("unknown", "g1", 5.0)], "sample_id string, gene string, x double")
    samples = spark.createDataFrame([(f"s{i}",) for i in range(12)], "sample_id string")
    rows = [(m, c, g, w, 1.0) for (m, c), own in sets.items() for g, w in own.items()]
    table = spark.createDataFrame(rows, "module string, control_id int, gene string, w double, one double")
    got = blocks.set_products(values, samples, table, ["module", "control_id"], ["w", "one"]).collect()
    assert len(got) == 12 * 14
    for r in got:
        own = sets[r.module, r.control_id]
        assert r.w == pytest.approx(sum(w * x.get((r.sample_id, g), 0.0) for g, w in own.items()), abs=1e-12)
        assert r.one == pytest.approx(sum(x.get((r.sample_id, g), 0.0) for g in own), abs=1e-12)


def test_empty_sides(spark):
    values = spark.createDataFrame([("s", "g", 1.0)], "sample_id string, gene string, x double")
    samples, sets = values.select("sample_id"), spark.createDataFrame([("k", "g", 2.0)], "k string, gene string, w double")
    assert blocks.set_products(values, samples, sets, ["k"], ["w"]).first().w == 2.0
    assert blocks.set_products(values.filter("false"), samples, sets, ["k"], ["w"]).first().w == 0.0
    assert blocks.set_products(values, samples.filter("false"), sets, ["k"], ["w"]).isEmpty()
    assert blocks.set_products(values, samples, sets.filter("false"), ["k"], ["w"]).isEmpty()
