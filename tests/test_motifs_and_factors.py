"""Weighted motifs against all triples, and the factorisation sweep against a plain one."""

import itertools
import math

import numpy as np
import pytest

from axonlake.operators import kernels, network

KEY = ["rec"]
ORDER = ((0, 1), (1, 0), (0, 2), (2, 0), (1, 2), (2, 1))


def brute_motifs(w, functional):
    out = {}
    for three in itertools.combinations(range(len(w)), 3):
        present = [(x, y) for x, y in itertools.permutations(three, 2) if w[x, y] > 0]
        patterns = [c for k in range(2, 7) for c in itertools.combinations(present, k)] if functional else [tuple(present)]
        for arcs in patterns:
            if len({frozenset(a) for a in arcs}) < 2:
                continue
            code = min(int("".join(str(int((q[i], q[j]) in arcs)) for i, j in ORDER), 2) for q in itertools.permutations(three))
            values = [w[a] for a in arcs]
            intensity = math.prod(values) ** (1 / len(values))
            for node in three:
                n, i, c = out.get((node, code), (0, 0.0, 0.0))
                out[node, code] = (n + 1, i + intensity, c + intensity / np.mean(values))
    return out


@pytest.mark.parametrize("functional", [False, True])
def test_weighted_motifs_against_all_triples(spark, functional):
    r = np.random.RandomState(3)
    w = (r.rand(9, 9) < 0.35) * r.randint(1, 40, (9, 9)) / 8.0
    np.fill_diagonal(w, 0)
    rows = [("a", int(i), int(j), float(w[i, j]) / 2) for i, j in zip(*np.nonzero(w))] * 2 + [("a", 1, 1, 5.0), ("a", 2, 8, 0.0)]  # arcs that repeat, a loop, a zero
    got = {(x.node, x.motif): (x.n, x.intensity, x.coherence) for x in network.weighted_motifs3(spark.createDataFrame(rows, "rec string, src long, dst long, w double"), KEY, functional).collect()}
    want = brute_motifs(w, functional)
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], rel=1e-9) for k in want)
    assert len({m for _, m in want}) <= 13


def test_thirteen_classes_as_counted_before(spark):
    assert len(set(network._pattern_classes().values())) == 13 and len(network._pattern_classes()) == 54
    r = np.random.RandomState(5)
    rows = [("a", int(i), int(j), 1.0) for i, j in itertools.permutations(range(8), 2) if r.rand() < 0.3]
    df = spark.createDataFrame(rows, "rec string, src long, dst long, w double")
    plain = {x.motif: x.n for x in network.motifs3(df, KEY).collect()}
    got = network.weighted_motifs3(df, KEY).groupBy("motif").sum("n").collect()
    assert {x.motif: x["sum(n)"] // 3 for x in got} == plain  # each pattern at its three nodes


def counts(spark, seed=1, bins=30):
    r = np.random.RandomState(seed)
    x = r.poisson(np.outer(np.tile([4, 0, 0], bins // 3), [1, 1, 1, 0, 0, 0]) + np.outer(np.tile([0, 5, 0], bins // 3), [0, 0, 0, 1, 1, 0]))
    x[4, 5] = 1  # one event is not active
    rows = [("a", int(c), int(b), int(x[b, c])) for b, c in zip(*np.nonzero(x))]
    return spark.createDataFrame(rows, "rec string, ch int, bin int, n int"), x[:, :5]


def test_variance_sweep_against_plain_factorisations(spark):
    df, x = counts(spark)
    got = {r.k: r for r in kernels.nmf_variance(df, 40).collect()}
    assert set(got) == set(range(1, 6)) and all(r.active == 5 for r in got.values())
    whole = np.concatenate([x, np.zeros((10, 5))])  # the bins without events
    used = x[x.any(axis=1)].astype(float)
    for k, r in got.items():
        residual = kernels._nmf_residual(used, k, np.random.RandomState(kernels.seed_of(1, k, "a")))
        error = residual**2 * used.size
        assert r.residual == pytest.approx(math.sqrt(error / whole.size)) and r.explained == pytest.approx(1 - error / ((whole - whole.mean()) ** 2).sum())
        best = (np.linalg.svd(used, compute_uv=False)[k:] ** 2).sum()  # no factorisation of rank k is closer
        assert error >= best - 1e-9 and error <= best + 0.2 * (used**2).sum()
    d = kernels.nmf_dimensions(df, 40, share=0.7).collect()[0]
    assert d.active == 5 and d.rank == min(k for k, r in got.items() if r.explained > 0.7) and d.relative == pytest.approx(d.components / 5)
    assert kernels.nmf_dimensions(df, 40, share=2.0).first()["rank"] == 5
