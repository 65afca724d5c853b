"""Regression by aggregates, order statistics by counts and density maps, against plain numpy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomgraph.operators import stats


def _nb2(beta: np.ndarray, log_alpha: float, x: np.ndarray, y: np.ndarray, w: np.ndarray) -> float:
    """Negative log-likelihood of counts with variance mu + alpha mu^2."""
    a = math.exp(log_alpha)
    mu = np.exp(np.clip(x @ beta, -30, 30))
    r = 1 / a
    lg = np.array([math.lgamma(v + r) - math.lgamma(v + 1) for v in y]) - math.lgamma(r)
    return float(-(w * (lg + r * np.log(r / (r + mu)) + y * np.log(mu / (r + mu)))).sum())


def fit_by_differences(cells: list[tuple[float, list[float], float]]) -> dict:
    """Weighted NB2 regression on (count, regressors, weight) cells: coef, se, alpha, loglik, by Newton with a numerical Hessian."""
    y, x, w = np.array([c[0] for c in cells], dtype=float), np.array([[1.0, *c[1]] for c in cells]), np.array([c[2] for c in cells], dtype=float)
    k = x.shape[1]
    start = np.zeros(k + 1)
    start[0] = math.log(max(1e-9, (w * y).sum() / w.sum()))
    start[k] = math.log(0.5)
    f = lambda t: _nb2(t[:k], t[k], x, y, w)

    def derivatives(t):
        h = 1e-4
        e = np.eye(k + 1) * h
        g = np.array([(f(t + e[i]) - f(t - e[i])) / (2 * h) for i in range(k + 1)])
        m = np.zeros((k + 1, k + 1))
        for i in range(k + 1):
            for j in range(i + 1):
                m[i, j] = m[j, i] = (f(t + e[i] + e[j]) - f(t + e[i] - e[j]) - f(t - e[i] + e[j]) + f(t - e[i] - e[j])) / (4 * h * h)
        return g, m

    t, best = start, f(start)
    for _ in range(60):
        g, m = derivatives(t)
        values, vectors = np.linalg.eigh(m)
        step = vectors @ ((vectors.T @ g) / np.maximum(np.abs(values), 1e-6))
        size = 1.0
        while size > 1e-8 and not f(t - size * step) < best:
            size /= 2
        if size <= 1e-8:
            break
        t = t - size * step
        moved, best = best - f(t), f(t)
        if moved < 1e-10:
            break
    se = np.sqrt(np.maximum(np.diag(np.linalg.pinv(derivatives(t)[1])), 0))
    return {"coef": t[:k].tolist(), "se": se[:k].tolist(), "alpha": math.exp(t[k]), "loglik": -best}


def drawn(n, seed):
    rng = np.random.default_rng(seed)
    x, z = rng.integers(0, 2, size=n).astype(float), rng.normal(size=n)
    mu = np.exp(0.8 + 0.5 * x - 0.3 * z)
    return x, z, rng.poisson(mu * rng.gamma(2.5, 0.4, size=n)).astype(float)


def test_count_regression_of_a_continuous_covariate(spark):
    """Against a numerical optimum and Hessian of the same likelihood; every row is a cell of its own."""
    x, z, y = drawn(600, 3)
    want = fit_by_differences([(a, [b, c], 1.0) for a, b, c in zip(y, x, z)])
    frame = spark.createDataFrame(list(zip(y.astype(int).tolist(), x.tolist(), z.tolist())) + [(None, 1.0, 0.0), (3, None, 1.0)], "y int, x double, z double").repartition(3)
    got = stats.nb2_fit(frame, "y", ["x", "z"])
    assert got["coef"] == pytest.approx(want["coef"], abs=1e-4) and got["se"] == pytest.approx(want["se"], rel=1e-3)
    assert got["alpha"] == pytest.approx(want["alpha"], rel=1e-3) and got["loglik"] == pytest.approx(want["loglik"], abs=1e-5) and got["rounds"] < 30
    table = {r.term: r for r in stats.nb2(frame, "y", "x", "z").collect()}
    assert set(table) == {"intercept", "multi", "year", "alpha"} and table["multi"].irr == pytest.approx(math.exp(want["coef"][1]), abs=1e-3)
    assert stats.nb2_fit(frame.limit(0), "y", ["x"])["alpha"] is None


def test_gradient_and_hessian():
    x, z, y = drawn(40, 5)
    m, w, theta = np.column_stack([np.ones(40), x, z]), np.linspace(0.5, 2, 40), np.array([0.7, 0.2, -0.4, -0.9])
    at = lambda t: stats._nb2_sums(y, m, w, t)
    assert at(theta)[0] == pytest.approx(-_nb2(theta[:3], theta[3], m, y, w), rel=1e-9)
    e = np.eye(4) * 1e-5
    assert at(theta)[1:5] == pytest.approx([(at(theta + d)[0] - at(theta - d)[0]) / 2e-5 for d in e], rel=1e-5)
    assert at(theta)[5:].reshape(4, 4) == pytest.approx(np.array([(at(theta + d)[1:5] - at(theta - d)[1:5]) / 2e-5 for d in e]), rel=1e-4, abs=1e-5)
    log_gamma, digamma, _ = stats._gamma_functions(np.array([0.01, 0.5, 1.0, 7.3, 250.0]))
    assert log_gamma == pytest.approx([math.lgamma(v) for v in (0.01, 0.5, 1.0, 7.3, 250.0)], rel=1e-9, abs=1e-9) and digamma[2] == pytest.approx(-0.5772156649, abs=1e-9)


@pytest.mark.parametrize("limit", [100_000, 20])
def test_order_statistics(spark, limit):
    rng = np.random.default_rng(4)
    groups = {"a": rng.normal(size=701), "b": np.repeat([1.5, 2.5], [300, 5]), "c": np.array([7.0]), "d": np.exp(rng.normal(size=400) * 9), "e": rng.integers(0, 3, size=50).astype(float)}
    rows = [(k, float(v)) for k, vs in groups.items() for v in vs] + [("a", None), (None, 1.0)]
    frame = spark.createDataFrame(rows, "k string, v double").repartition(3)
    places = lambda n: [F.floor((n - 1) / 2), F.floor(n / 2), n - 1]
    got = {r.k: (r.n, r.v0, r.v1, r.v2) for r in stats.order_statistic(frame, "v", ("k",), places, limit).collect()}
    assert got == {k: (len(v), *(float(np.sort(v)[i]) for i in ((len(v) - 1) // 2, len(v) // 2, len(v) - 1))) for k, v in groups.items()}
    every = np.sort([v for _, v in rows if v is not None])
    assert tuple(stats.order_statistic(frame, "v", limit=limit).first()) == (len(every), every[len(every) // 2])
    assert stats.order_statistic(frame.limit(0), "v").count() == 0


def test_density_of_correlated_points(spark):
    rng = np.random.default_rng(5)
    pts = rng.normal(size=(90, 2)) @ np.array([[1.0, 0.6], [0.0, 0.5]])
    frame = spark.createDataFrame([*pts.tolist(), [None, 1.0]], "x double, y double")

    def full(p, gx, gy):
        inverse = np.linalg.inv(np.cov(p.T) * len(p) ** (-1 / 3))
        d = np.array([[sum(math.exp(-0.5 * (q - [a, b]) @ inverse @ (q - [a, b])) for q in p) for b in gy] for a in gx])
        return d / d.max()

    for limits, p in ((None, pts), ((-1.0, 1.0), pts[np.abs(pts[:, 0]) <= 1])):
        got = {(r.gx, r.gy): r.density for r in stats.kde(frame, "x", "y", 7, limits).collect()}
        gx, gy = np.linspace(*(limits or (p[:, 0].min(), p[:, 0].max())), 7), np.linspace(p[:, 1].min(), p[:, 1].max(), 7)
        assert got == pytest.approx({(a, b): v for a, row in zip(gx, full(p, gx, gy)) for b, v in zip(gy, row)}, abs=1e-9)
    assert stats.kde(frame.limit(1), "x", "y").count() == 0
    line = spark.createDataFrame([(float(k), 2.0 * k) for k in range(10)], "x double, y double")
    assert stats.kde(line, "x", "y", 5).count() == 25
    log = stats.kde(frame.selectExpr("exp(x) + 1 AS x", "y"), "x", "y", 5, log_x=True).select("gx").distinct().collect()
    steps = sorted(r.gx for r in log)
    assert np.diff(np.log(steps)) == pytest.approx([np.log(steps[1] / steps[0])] * 4)


def test_ranges(spark):
    frame = spark.createDataFrame([(1, 2.0, 5.0), (2, 4.0, 5.0), (3, None, 5.0)], "k int, x double, y double")
    assert [tuple(r) for r in stats.min_max(frame, ["x", "y"]).orderBy("k").collect()] == [(1, 0.0, 0.0), (2, 1.0, 0.0), (3, None, 0.0)]
