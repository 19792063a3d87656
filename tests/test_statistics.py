import math

import numpy as np
import pytest

from loomline.operators import statistics as S


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(1)
    n = 900
    x, g = rng.normal(size=n), rng.integers(0, 30, n)
    c = rng.integers(0, 3, n)
    y = 1 + 2 * x + 0.5 * (c == 1) - (c == 2) + rng.normal(size=30)[g] + rng.normal(size=n)
    b = (rng.random(n) < 1 / (1 + np.exp(-(0.3 + x - 0.7 * (c == 2))))).astype(int)
    rows = [(float(u), float(v), int(w), int(k), f"c{h}") for u, v, w, k, h in zip(y, x, b, g, c, strict=True)]
    df = spark.createDataFrame([*rows, (None, 1.0, 1, 1, "c0"), (1.0, None, 0, 2, "c1")], "y double, x double, b int, g int, c string").repartition(4)
    X = np.column_stack([np.ones(n), x, c == 1, c == 2]).astype(float)
    return df, X, y, b.astype(float), g


def test_ols_matches_closed_form(data):
    df, X, y, _, g = data
    f = S.fit(df, "y ~ x + C(c)")
    beta = np.linalg.solve(X.T @ X, X.T @ y)
    e = y - X @ beta
    cov = np.linalg.inv(X.T @ X) * (e @ e) / (len(y) - 4)
    assert f.names == ["Intercept", "x", "c[c1]", "c[c2]"] and f.n == len(y)
    np.testing.assert_allclose(f.coef, beta, atol=1e-9)
    np.testing.assert_allclose(f.cov, cov, atol=1e-10)
    assert f.goodness == pytest.approx(1 - e @ e / ((y - y.mean()) ** 2).sum())
    bread = np.linalg.inv(X.T @ X)
    u = np.array([(X[g == k] * e[g == k, None]).sum(0) for k in np.unique(g)])
    n, G = len(y), len(u)
    want = bread @ u.T @ u @ bread * G / (G - 1) * (n - 1) / (n - 4)
    np.testing.assert_allclose(S.fit(df, "y ~ x + C(c)", cluster="g").cov, want, atol=1e-10)


def test_logit_matches_newton(data):
    df, X, _, b, _ = data
    beta = np.zeros(4)
    for _ in range(30):
        p = 1 / (1 + np.exp(-X @ beta))
        beta += np.linalg.solve((X * (p * (1 - p))[:, None]).T @ X, X.T @ (b - p))
    f = S.fit(df.where("y is not null"), "b ~ x + C(c)", "logit")
    np.testing.assert_allclose(f.coef, beta, atol=1e-7)


def test_interactions_and_too_few_rows(spark, data):
    df = data[0]
    assert S.design(df, "y ~ C(c) * x")[1] == ["Intercept", "c[c1]", "c[c2]", "x", "c[c1]:x", "c[c2]:x"]
    few = S.fit(df.limit(2), "y ~ x + C(c)")
    assert np.isnan(few.coef).all()
    assert np.isnan(S.fit(df.where("y is null and x is null"), "y ~ x").coef).all()


def test_tails():
    assert S.t_tail(2.0, 10) == pytest.approx(0.07338803, abs=1e-7)
    assert S.z_tail(1.959964) == pytest.approx(0.05, abs=1e-6)
    assert S.chi2_tail(3.841459, 1) == pytest.approx(0.05, abs=1e-6)
    assert S.chi2_tail(20.0, 10) == pytest.approx(0.02925269, abs=1e-7)


def test_kappa_of_itself_and_chance(spark):
    same = spark.createDataFrame([("a", "a"), ("b", "b"), ("a", "a"), (None, "a"), ("x", "a")], "p string, q string")
    row = S.kappa(same, "p", "q", ["a", "b"]).first()
    assert (row["n"], row["agreement"], row["kappa"]) == (3, 1.0, 1.0)
    cross = spark.createDataFrame([("a", "a"), ("a", "b"), ("b", "a"), ("b", "b")], "p string, q string")
    assert S.kappa(cross, "p", "q", ["a", "b"], "linear").first()["kappa"] == pytest.approx(0)
    assert S.kappa(same.limit(0), "p", "q", ["a", "b"]).first()["n"] == 0


def test_benjamini_hochberg(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.6]
    got = {r["v"]: (r["bonferroni"], r["bh"]) for r in S.adjusted(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "v int, pvalue double")).collect()}
    assert got[3] == pytest.approx((0.025, 0.025)) and got[0] == pytest.approx((0.05, 0.025)) and got[1] == pytest.approx((0.2, 0.05)) and got[4][1] == pytest.approx(0.6)
    assert not math.isnan(got[2][1])
