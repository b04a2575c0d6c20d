"""Ridge by the kernel of rows against the one by products of features."""

import numpy as np
import pytest

from areasignal.operators import kernel, learn


def frame(spark, n, d, folds, seed=1):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, d)) * rng.uniform(0.1, 5, d) + rng.normal(size=d)
    x[:, 0] = 3.0
    y = x[:, 1:3] @ [[1.0, 0.2], [-0.5, 1.0]] + rng.normal(size=(n, 2))
    rows = [(i, i % folds, x[i].tolist(), *y[i].tolist()) for i in range(n)]
    return spark.createDataFrame(rows, "u int, fold int, x array<double>, a double, b double").repartition(4)


@pytest.mark.parametrize(("n", "d", "folds", "scale"), [(60, 90, 4, True), (40, 700, 3, True), (30, 50, 1, True), (45, 60, 3, False)])
def test_same_as_by_features(spark, monkeypatch, n, d, folds, scale):
    monkeypatch.setattr(kernel, "TILE", 64)
    monkeypatch.setattr(kernel, "BLOCK", 16)
    df = frame(spark, n, d, folds)
    assert kernel.use(n, d)
    small = learn.fitted(df, "u", "fold", "x", ["a", "b"], scale=scale)
    monkeypatch.setattr(kernel, "use", lambda n, d: False)
    large = learn.fitted(df, "u", "fold", "x", ["a", "b"], scale=scale)
    assert set(small) == set(large) and len(small) == folds
    for k in small:
        assert (small[k].alpha == large[k].alpha).all()
        assert np.allclose(small[k].weights, large[k].weights, atol=1e-8, rtol=1e-6)


def test_one_penalty_and_few_rows(spark, monkeypatch):
    df = frame(spark, 5, 9, 5)
    small = learn.fitted(df, "u", "fold", "x", ["a", "b"], alphas=[2.0])
    monkeypatch.setattr(kernel, "use", lambda n, d: False)
    large = learn.fitted(df, "u", "fold", "x", ["a", "b"], alphas=[2.0])
    assert all(np.allclose(small[k].weights, large[k].weights, atol=1e-8) for k in large)
    assert not kernel.use(kernel.DUAL_ROWS + 1, 1 << 20) and not kernel.use(100, 100)
