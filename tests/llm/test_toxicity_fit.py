"""The machine of the toxicity scores, fitted by sums over Spark, against its objective written out plainly."""

import numpy as np

from cohortlens.llm import toxicity


def test_svm_reaches_the_least_loss(spark):
    rng = np.random.default_rng(2)
    width, penalty = 6, 1e-3
    near = rng.random((300, width)).astype(np.float16) * (rng.random((300, width)) < 0.3)
    near[:20] = 0
    count = rng.integers(1, 6, 300)
    root = np.eye(width) + 0.1 * rng.random((width, width))
    rows = [(b"" if not x.any() else x.astype(np.float16).tobytes(), int(n)) for x, n in zip(near, count, strict=True)]
    clean = spark.createDataFrame(rows, "x binary, n bigint").repartition(5)
    good = np.hstack([(rng.random((40, width)) * 1.5) @ root, np.ones((40, 1))])
    w = toxicity.svm(clean, root, (good, np.ones(40)), np.zeros(width + 1), penalty)

    bad = np.hstack([near.astype(np.float64) @ root, np.ones((300, 1))])
    share = 40 / count.sum()

    def loss(v):
        hinge = (np.maximum(0, 1 - good @ v) ** 2).sum() + share * (count * np.maximum(0, 1 + bad @ v) ** 2).sum()
        return hinge / 80 + penalty * (v[:-1] @ v[:-1] + 1e-6 * v[-1] ** 2)

    slope = [(loss(w + e) - loss(w - e)) / 2e-5 for e in 1e-5 * np.eye(width + 1)]
    assert np.abs(slope).max() < 1e-6
    assert loss(w) < loss(np.zeros(width + 1))


def test_svm_without_clean_rows(spark):
    empty = spark.createDataFrame([], "x binary, n bigint")
    w = toxicity.svm(empty, np.eye(2), (np.array([[1.0, 0.0, 1.0]]), np.ones(1)), np.zeros(3))
    assert np.isfinite(w).all() and np.array([1.0, 0.0, 1.0]) @ w > 0.9
