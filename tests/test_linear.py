"""Squared-hinge machines against the optimum found by plain numpy."""

import numpy as np
import pandas as pd
import pytest

from tabulon.operators import linear, models
from tabulon.operators.encode import assemble

FEATS = ["a", "b", "c"]


def table(spark, n=400, scale=1.0, seed=1, partitions=5):
    rng = np.random.default_rng(seed)
    pdf = pd.DataFrame(rng.normal(size=(n, 3)) * [1.0, scale, 0.1], columns=FEATS)
    score = pdf.a + pdf.b / scale + rng.normal(size=n) * 0.7
    pdf["label"] = np.where(score > 1.2, 2.0, np.where(score < -0.3, 0.0, 1.0))
    return pdf, assemble(spark.createDataFrame(pdf).repartition(partitions), FEATS)


def objective(beta, x, y, s, c):
    return 0.5 * beta @ beta + c * (s * np.maximum(0, 1 - y * (x @ beta)) ** 2).sum()


def optimum(x, y, s, c):
    """Gradient steps with momentum, restarted when the objective rises; slow and plain."""
    beta = last = np.zeros(x.shape[1])
    rate = 1.0 / (1 + 2 * c * np.linalg.eigvalsh((x * s[:, None]).T @ x)[-1])
    k, best = 0, np.inf
    for _ in range(200_000):
        ahead = beta + k / (k + 3) * (beta - last)
        gap = np.maximum(0, 1 - y * (x @ ahead))
        gradient = ahead - 2 * c * x.T @ (s * y * gap)
        last, beta, k = beta, ahead - rate * gradient, k + 1
        now = objective(beta, x, y, s, c)
        if now > best:
            k = 0
        best = min(best, now)
        if np.abs(gradient).max() < 1e-9:
            break
    return beta


@pytest.mark.parametrize("balanced,c", [(True, 1.0), (False, 0.05)])
def test_machines_reach_the_optimum(spark, balanced, c):
    pdf, df = table(spark)
    got = linear.fit_squared_hinge(df, c, balanced)
    x = np.column_stack([pdf[FEATS].to_numpy(), np.ones(len(pdf))])
    assert got.classes == (0.0, 1.0, 2.0)
    for i, k in enumerate(got.classes):
        y = np.where(pdf.label == k, 1.0, -1.0)
        s = np.where(y > 0, len(y) / (3 * (y > 0).sum()) if balanced else 1.0, 1.0)
        want = optimum(x, y, s, c)
        beta = np.append(got.weights[i], got.intercepts[i])
        assert np.allclose(beta, want, atol=1e-6)


def test_columns_of_very_different_size(spark):
    """The gradient vanishes although one column is a million times another."""
    pdf, df = table(spark, scale=1e6)
    got = linear.fit_squared_hinge(df)
    x = np.column_stack([pdf[FEATS].to_numpy(), np.ones(len(pdf))])
    for i, k in enumerate(got.classes):
        y = np.where(pdf.label == k, 1.0, -1.0)
        s = np.where(y > 0, len(y) / (3 * (y > 0).sum()), 1.0)
        beta = np.append(got.weights[i], got.intercepts[i])
        gap = np.maximum(0, 1 - y * (x @ beta))
        size = np.abs(x).T @ s
        assert (np.abs(beta - 2 * x.T @ (s * y * gap)) / size).max() < 1e-6


def test_partitions_do_not_matter_and_separable_rows_end(spark):
    _, one = table(spark, partitions=1)
    _, many = table(spark, partitions=16)
    a, b = (linear.fit_squared_hinge(df) for df in (one, many))
    assert np.allclose(a.weights, b.weights, rtol=1e-8)
    easy = assemble(spark.createDataFrame([(float(i % 2), float(i % 2), 1.0 * i) for i in range(40)], "label double, a double, b double"), ["a", "b"])
    model = linear.fit_squared_hinge(easy, c=100.0)
    assert model.transform(easy).filter("label <> prediction").count() == 0


def test_passes_are_few(spark, monkeypatch):
    passes, real = [], linear._hinge_moments
    monkeypatch.setattr(linear, "_hinge_moments", lambda *a: passes.append(1) or real(*a))
    _, df = table(spark, n=2000, scale=1e4)
    models.linear_svc()(df)
    assert len(passes) <= 25


def test_single_class(spark):
    df = assemble(spark.createDataFrame([(3.0, float(i)) for i in range(5)], "label double, a double"), ["a"])
    model = linear.fit_squared_hinge(df)
    assert {r["prediction"] for r in model.transform(df).collect()} == {3.0}
