"""Approximate leave-one-out against fitting the model once for every row."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from faultline.operators import classify, leaveout


def fit(z, y, w, k, penalty, theta):
    """Newton's method on the weighted, penalised loss."""
    n, m = z.shape
    free = np.append(np.ones(m - 1), 0.0)
    for _ in range(30):
        p = leaveout._probabilities(z, theta)
        gradient = ((p - np.eye(k)[y]) * w[:, None]).T @ z + penalty * theta * free
        second = np.zeros((k, m, k, m))
        for a in range(k):
            for b in range(k):
                second[a, :, b] = z.T @ (z * (w * p[:, a] * ((a == b) - p[:, b]))[:, None])
        second = second.reshape(k * m, k * m) + np.diag(penalty * np.tile(free, k))
        step = np.linalg.pinv(second, hermitian=True) @ gradient.ravel()
        theta = theta - step.reshape(k, m)
        if np.abs(step).max() < 1e-9:
            break
    return theta


def test_close_to_real_leave_one_out(spark):
    rng = np.random.default_rng(8)
    n, k = 500, 3
    y = rng.choice(k, n, p=[0.6, 0.3, 0.1])
    x = rng.normal(size=(n, 5)) + 0.8 * np.eye(5)[y]
    rows = [(i, [float(v) for v in x[i]], f"c{y[i]}") for i in range(n)] + [(900, None, "c1")]
    index = spark.createDataFrame(rows, "key BIGINT, vec ARRAY<DOUBLE>, label STRING").repartition(7)
    model, classes = classify.train_component_lr(index, tol=1e-10)
    found = {r.key: r for r in leaveout.approximate_loo(index, model, classes).collect()}
    assert sorted(found) == list(range(n)) and classes == ["c0", "c1", "c2"]
    z = np.hstack([x, np.ones((n, 1))])
    w = (n / (k * np.bincount(y)))[y]
    start = fit(z, y, w, k, 1.0, np.zeros((k, 6)))
    theta = np.hstack([model.coefficientMatrix.toArray(), model.interceptVector.toArray()[:, None]])
    # the gradient at Spark's optimum is zero: predictions are those of the exact optimum
    assert np.allclose(leaveout._probabilities(z, theta), leaveout._probabilities(z, start), atol=1e-4)
    keep = np.ones(n, bool)
    real, close = 0, []
    for i in range(n):
        keep[i] = False
        p = leaveout._probabilities(z[i : i + 1], fit(z[keep], y[keep], w[keep], k, 1.0, start))[0]
        keep[i] = True
        real += p.argmax() == y[i]
        close.append(abs(p[classes.index(found[i].component)] - found[i].confidence))
    approximate = sum(r.component == r.label for r in found.values())
    assert abs(real - approximate) <= 0.01 * n and max(close) < 0.02
    seen = (leaveout._probabilities(z, start).argmax(axis=1) == y).sum()
    assert approximate <= seen  # rows left out are not easier than rows seen


def test_limits(spark, monkeypatch):
    index = spark.createDataFrame([(i, [float(i % 2), 1.0], f"c{i % 2}") for i in range(20)], "key BIGINT, vec ARRAY<DOUBLE>, label STRING")
    model, classes = classify.train_component_lr(index)
    assert leaveout.approximate_loo(index.limit(0), model, classes).collect() == []
    unknown = index.unionByName(index.limit(1).withColumn("label", F.lit("new")).withColumn("key", F.lit(99).cast("bigint")))
    assert 99 not in {r.key for r in leaveout.approximate_loo(unknown, model, classes).collect()}
    monkeypatch.setattr(leaveout, "PARAMETERS", 3)
    with pytest.raises(ValueError):
        leaveout.approximate_loo(index, model, classes)
