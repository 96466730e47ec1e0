"""Mixed models against the dense likelihood, written out with the full covariance matrix."""

import math

import numpy as np
import pytest

from axonlake.operators import mixed


def simulate(seed, subjects=30, slope=False, groups=3):
    r = np.random.RandomState(seed)
    rows = []
    for s in range(subjects):
        g, a, b = s % groups, r.normal(0, 1.2), r.normal(0, 0.3) if slope else 0.0
        for age in r.choice([7, 14, 21, 28, 35], r.randint(1, 6), replace=False):
            for _ in range(r.randint(1, 3)):
                rows.append((f"s{s}", "abc"[g], float(age), float(2 + 0.1 * age + 0.8 * g + 0.05 * g * age + a + b * (age - 21) / 7 + r.normal(0, 0.7))))
    return rows


def dense(rows, covariance, variance, group, interaction, slope, restricted):
    """-2 log likelihood and generalised least-squares coefficients with the whole covariance matrix of all rows."""
    age, y = np.array([r[2] for r in rows]), np.array([r[3] for r in rows])
    levels = sorted({r[1] for r in rows})[1:] if group else []
    dummies = [np.array([r[1] == g for r in rows], float) for g in levels]
    x = np.stack([np.ones(len(y)), age, *dummies, *([d * age for d in dummies] if interaction else [])], 1)
    z = np.stack([np.ones(len(y)), age], 1)[:, : 2 if slope else 1]
    same = np.array([[a[0] == b[0] for b in rows] for a in rows])
    v = same * (z @ covariance @ z.T) + variance * np.eye(len(y))
    inverse = np.linalg.inv(v)
    a = x.T @ inverse @ x
    beta = np.linalg.solve(a, x.T @ inverse @ y)
    e = y - x @ beta
    loss = np.linalg.slogdet(v)[1] + e @ inverse @ e + (len(y) - (x.shape[1] if restricted else 0)) * math.log(2 * math.pi)
    return loss + (np.linalg.slogdet(a)[1] if restricted else 0), beta, np.sqrt(np.diag(np.linalg.inv(a)))


@pytest.mark.parametrize("group, interaction, slope, restricted", [(False, False, False, True), (True, False, False, False), (True, True, False, True), (True, True, True, True), (False, False, True, False)])
def test_fit_against_the_dense_likelihood(spark, group, interaction, slope, restricted):
    rows = simulate(4, slope=slope)
    df = spark.createDataFrame([("m", *r) for r in rows] + [("m", None, "a", 7.0, 1.0), ("m", "s1", "a", None, 1.0), ("m", "s1", "a", 7.0, None)], "metric string, subject string, grp string, age double, value double")
    got = mixed.mixed_effects(df, ["metric"], group="grp" if group else None, interaction=interaction, slope=slope, restricted=restricted).collect()
    terms = ["intercept", "age"] + (["grp=b", "grp=c"] if group else []) + (["age:grp=b", "age:grp=c"] if interaction else [])
    assert [r.term for r in got] == terms
    g = got[0]
    cov = np.array([[g.var_intercept, g.cov], [g.cov, g.var_slope]]) if slope else np.array([[g.var_intercept]])
    args = (group, interaction, slope, restricted)
    loss, beta, se = dense(rows, cov, g.variance, *args)
    assert g.minus2_log_likelihood == pytest.approx(loss, rel=1e-7)
    assert [r.estimate for r in got] == pytest.approx(beta, rel=1e-5, abs=1e-6) and [r.se for r in got] == pytest.approx(se, rel=1e-5)
    for r in got:
        assert r.df == len(rows) - len(terms) and r.t == pytest.approx(r.estimate / r.se) and 0 <= r.p <= 1
    rng = np.random.RandomState(1)
    for _ in range(30):  # no covariance near it or elsewhere is more likely
        low = np.linalg.cholesky(cov + 1e-9 * np.eye(len(cov))) * np.exp(rng.normal(0, 0.3, cov.shape))
        assert dense(rows, low @ low.T, g.variance * math.exp(rng.normal(0, 0.2)), *args)[0] >= loss - 1e-5


def test_effects_are_found_and_models_compared(spark):
    rows = [("with", *r) for r in simulate(1, 60)] + [("without", s, g, a, v - 0.05 * "abc".index(g) * a) for s, g, a, v in simulate(2, 60)]
    df = spark.createDataFrame(rows, "metric string, subject string, grp string, age double, value double")
    fits = [mixed.mixed_effects(df, ["metric"], group="grp", interaction=i, restricted=False) for i in (False, True)]
    effect = {(r.metric, r.term): r for r in fits[1].collect()}
    assert effect["with", "age"].estimate == pytest.approx(0.1, abs=0.04) and effect["with", "age:grp=c"].p < 0.001 < 0.01 < effect["without", "age:grp=c"].p
    tests = {r.metric: r for r in mixed.compare_models(*fits, ["metric"]).collect()}
    assert tests["with"].p < 1e-3 and tests["without"].p > 0.01 and all(t.df == 2 and t.statistic >= -1e-6 for t in tests.values())


def test_degenerate_tables(spark):
    schema = "metric string, subject string, grp string, age double, value double"
    same = spark.createDataFrame([("m", f"s{i}", "a", float(i % 3), 5.0) for i in range(9)], schema)
    assert mixed.mixed_effects(same, ["metric"]).count() == 0 and mixed.mixed_effects(same.limit(0), ["metric"], group="grp").count() == 0
    flat = spark.createDataFrame([("m", f"s{i // 3}", "a", 2.0, float(i * i % 7)) for i in range(12)], schema)
    assert {r.term for r in mixed.mixed_effects(flat, ["metric"]).collect()} == {"intercept", "age"}
    alone = spark.createDataFrame([(f"s{i // 3}", float(i % 3), float(i * i % 7)) for i in range(12)], "subject string, age double, value double")
    assert mixed.mixed_effects(alone, []).count() == 2


def test_tails_and_search():
    for df in (1, 2, 3, 7, 30):
        for x in (0.1, 1.0, df, 3.0 * df):
            grid = np.linspace(0, x, 200_001)[1:]
            density = grid ** (df / 2 - 1) * np.exp(-grid / 2) / (2 ** (df / 2) * math.gamma(df / 2))
            if df > 1:
                assert mixed.chi_square_tail(x, df) == pytest.approx(1 - np.trapezoid(density, grid), abs=2e-4)
    assert mixed.chi_square_tail(3.841458820694124, 1) == pytest.approx(0.05, abs=1e-9)
    value, at = mixed.nelder_mead(lambda p: (p[0] - 3) ** 2 + 10 * (p[1] - p[0] ** 2 / 3) ** 2, np.array([0.0, 0.0]))
    assert value < 1e-8 and at == pytest.approx([3, 3], abs=1e-3)
