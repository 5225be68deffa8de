"""Squared-hinge SVM against Newton steps on the whole matrix."""

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors

from tagweave.operators import squared_hinge as SH
from tagweave.operators.mllib import predict_online


def problem(n=120, dim=15, seed=1):
    rng = np.random.default_rng(seed)
    y = rng.integers(0, 3, n)
    x = rng.random((n, dim)) * (rng.random((n, dim)) < 0.4)
    x[np.arange(n), y] += 0.6
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-9), y


def table(spark, x, y):
    return spark.createDataFrame([(i, Vectors.dense(r.tolist()), int(k)) for i, (r, k) in enumerate(zip(x, y))], ["id", "features", "y"]).repartition(3)


def objective(w, x, t, C):
    return w @ w / 2 + C * (np.maximum(1 - t * (x @ w), 0) ** 2).sum()


def minimum(x, t, C):
    """By Newton steps on the active rows, halved until the objective falls."""
    w = np.zeros(x.shape[1])
    for _ in range(200):
        on = t * (x @ w) < 1
        grad = w - 2 * C * x[on].T @ (t[on] - x[on] @ w)
        move, size = np.linalg.solve(np.eye(len(w)) + 2 * C * x[on].T @ x[on], grad), 1.0
        while objective(w - size * move, x, t, C) > objective(w, x, t, C) and size > 1e-9:
            size /= 2
        w = w - size * move
    return w


@pytest.mark.parametrize("C", [1.0, 1000.0])
def test_reaches_the_minimum(spark, C):
    x, y = problem()
    data = table(spark, x, y)
    w, gap = SH.fit_squared_hinge(data, 3, 15, SH.SvmParams(C=C, tol=1e-4))
    assert w.shape == (3, 16) and (gap <= 1e-4).all() and (gap >= -1e-9).all()
    xb = np.hstack([x, np.ones((len(x), 1))])
    for k in range(3):
        t = np.where(y == k, 1.0, -1.0)
        best = objective(minimum(xb, t, C), xb, t, C)
        assert best * (1 - 1e-9) <= objective(w[k], xb, t, C) <= best * (1 + 2e-4)
    got = {r["id"]: int(r["prediction"]) for r in predict_online(data, w).collect()}
    assert [got[i] for i in range(len(x))] == (xb @ w.T).argmax(axis=1).tolist()
    assert np.mean([got[i] == k for i, k in enumerate(y)]) > 0.8


def test_edges(spark):
    """No rows, one class only, rows without features, a bound on the weights."""
    none = table(spark, *problem(2)).where("id < 0")
    w, _ = SH.fit_squared_hinge(none, 2, 15)
    assert not w.any()
    w, gap = SH.fit_squared_hinge(table(spark, np.zeros((6, 3)), [0] * 6), 2, 3, SH.SvmParams(tol=1e-6))
    # Only the bias: min b^2 / 2 + 6 (1 - b)^2 is at 12 / 13.
    assert np.allclose(w, [[0, 0, 0, 12 / 13], [0, 0, 0, -12 / 13]], atol=1e-3) and (gap <= 1e-6).all()
    with pytest.raises(ValueError):
        SH.fit_squared_hinge(none, 1 << 20, 1 << 20)
