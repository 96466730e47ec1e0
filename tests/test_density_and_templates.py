"""Bandwidths, basins, principal loadings, clusters and templates against plain versions."""

import math

import numpy as np
import pytest

from axonlake.operators import density as de
from axonlake.operators import templates as tp


def plain_bandwidth(x):
    """Every pair of different values written out; the normal-scale width where a functional has the wrong sign."""
    n, root = len(x), math.sqrt(2 * math.pi)
    d = np.subtract.outer(x, x).ravel()
    d = d[d != 0]
    eighth = 105 / (32 * math.sqrt(math.pi) * np.std(x, ddof=1) ** 9)
    g = (2 * 15 / root / (eighth * n)) ** (1 / 9)
    u = d / g
    sixth = ((u**6 - 15 * u**4 + 45 * u**2 - 15) * np.exp(-u * u / 2) / root).sum() / (n * (n - 1) * g**7)
    scale = np.std(x, ddof=1) * (4 / (3 * n)) ** 0.2
    if not sixth < 0:
        return scale
    g = (-2 * 3 / root / (sixth * n)) ** (1 / 7)
    u = d / g
    fourth = ((u**4 - 6 * u**2 + 3) * np.exp(-u * u / 2) / root).sum() / (n * (n - 1) * g**5)
    return (1 / (2 * math.sqrt(math.pi)) / (fourth * n)) ** 0.2 if fourth > 0 else scale


def test_plug_in_bandwidth(spark):
    r = np.random.RandomState(1)
    one, two = r.normal(0, 1, 500), np.concatenate([r.normal(-3, 0.5, 300), r.normal(4, 0.3, 300)])
    tied, coarse = np.round(r.normal(0, 1, 400), 2), np.round(r.normal(0, 1, 400), 1)
    rows = [("coarse", float(v)) for v in coarse] + [("one", float(v)) for v in one] + [("two", float(v)) for v in two] + [("tied", float(v)) for v in tied]
    rows += [("equal", 2.0)] * 5 + [("single", 1.0), ("one", None), ("one", float("nan")), ("none", None)]
    got = {x.k: (x.n, x.h) for x in de.plug_in_bandwidth(spark.createDataFrame(rows, "k string, v double"), ["k"], "v").collect()}
    assert got["one"] == (500, pytest.approx(plain_bandwidth(one), rel=1e-3))
    assert got["two"] == (600, pytest.approx(plain_bandwidth(two), rel=1e-3))
    assert got["tied"] == (400, pytest.approx(plain_bandwidth(tied), rel=1e-3))
    assert got["coarse"] == (400, pytest.approx(plain_bandwidth(coarse), rel=1e-3))  # too many equal values: normal scale
    assert got["equal"] == (5, None) and got["single"] == (1, None) and "none" not in got


def climb(density):
    """Where the walk to the densest neighbour ends, from every place."""
    out = np.zeros(density.shape, int)
    for i in range(density.shape[0]):
        for j in range(density.shape[1]):
            a, b = i, j
            while True:
                best = max(((density[p, q], -(p * density.shape[1] + q)), p, q) for p in range(max(a - 1, 0), min(a + 2, density.shape[0])) for q in range(max(b - 1, 0), min(b + 2, density.shape[1])))
                if (best[1], best[2]) == (a, b):
                    break
                a, b = best[1:]
            out[i, j] = a * density.shape[1] + b
    return out


def test_basins_are_where_climbing_ends():
    r = np.random.RandomState(2)
    for n in range(30):
        d = r.rand(9, 7) + 0.1 if n % 2 else r.randint(1, 4, (8, 8)).astype(float)  # the latter with ties
        basin, peaks = de.mark_basins(d, 0.0, 0.0)
        assert (peaks[basin - 1] == climb(d)).all()
        assert (np.diff(d.ravel()[peaks]) <= 0).all()


def test_shallow_basins_join_deep_ones():
    line = np.array([[1.0, 5.0, 4.5, 4.8, 1.0, 3.0, 0.0]])
    assert de.mark_basins(line, 0.0, 0.0)[0].tolist() == [[1, 1, 1, 2, 2, 3, 0]]
    assert de.mark_basins(line, 0.1, 0.0)[0].tolist() == [[1, 1, 1, 1, 1, 2, 0]]
    assert de.mark_basins(line, 0.9, 0.0)[0].tolist() == [[1, 1, 1, 1, 1, 1, 0]]
    assert de.mark_basins(line, 0.0, 0.5)[0].tolist() == [[0, 1, 1, 2, 0, 3, 0]]


def test_density_basins(spark):
    r = np.random.RandomState(3)
    a, b = r.normal([0.2, -1], [0.03, 0.3], (400, 2)), r.normal([0.7, 2], [0.04, 0.4], (200, 2))
    pts = np.concatenate([a, b])
    rows = [("net", float(x), float(y)) for x, y in pts] + [("flat", float(x), 1.0) for x in a[:, 0]] + [("lone", 1.0, 2.0), ("net", None, 1.0), (None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "k string, x double, y double")
    grid = de.density_basins(df, ["k"], "x", "y", points=24, depth=0.5).cache()
    got = {k: [x for x in grid.collect() if x.k == k] for k in ("net", "flat", "lone")}
    assert [len(got[k]) for k in ("net", "flat", "lone")] == [576, 24, 1]
    hx, hy = plain_bandwidth(pts[:, 0]), plain_bandwidth(pts[:, 1])
    top = max(x.density for x in got["net"])
    for x in got["net"]:
        z = ((x.x - pts[:, 0]) / hx) ** 2 + ((x.y - pts[:, 1]) / hy) ** 2
        assert x.density == pytest.approx(np.exp(-z / 2).mean() / (2 * math.pi * hx * hy), rel=0.02, abs=2e-3 * top)
    assert sorted((round(x.x, 1), x.basin) for x in got["net"] if x.peak) == [(0.2, 1), (0.7, 2)]
    assert [(x.density, x.basin, x.peak) for x in got["lone"]] == [(1.0, 1, True)]
    back = de.basin_of(df, grid, ["k"], "x", "y").collect()
    assert len(back) == len(rows)
    assert all(x.basin in ({1, None} if x.x < 0.45 else {2, None}) for x in back if x.k == "net" and x.x is not None)
    assert sum(x.basin is None for x in back if x.k == "net") <= 10
    assert [x.basin for x in back if x.k is None or x.x is None] == [None, None]


def waves():
    r = np.random.RandomState(4)
    i = np.arange(51)
    narrow, wide = -40 * np.exp(-(((i - 25) / 2.0) ** 2)), -90 * np.exp(-(((i - 25) / 5.0) ** 2)) + 15 * np.exp(-(((i - 40) / 4.0) ** 2))
    return [("r", c, w, [float(v) for v in (narrow if w == 0 else wide) * r.normal(1, 0.04) + r.normal(0, 0.5, 51)]) for c in (0, 1) for w, n in ((0, 120), (1, 60)) for _ in range(n)]


def test_shape_features(spark):
    rows = waves() + [("r", 2, 0, [-1.0] * 51), ("r", 2, 0, None), ("r", 2, 0, [])]
    for x in tp.shape_features(spark.createDataFrame(rows, "rec string, ch int, kind int, waveform array<double>"), 12500.0).collect():
        if not x.waveform:
            assert (x.amplitude, x.width, x.asymmetry) == (None, None, 0.0)
            continue
        w = np.array(x.waveform)
        above = np.flatnonzero(w > w[25] / 2)
        left, right = above[above < 25], above[above > 25]
        assert x.amplitude == w[25] and x.asymmetry == pytest.approx(np.abs(w[:25] - w[26:][::-1]).sum())
        assert x.width is None if not len(left) or not len(right) else x.width == pytest.approx((right.min() - left.max()) / 12500)


def test_loadings_equal_a_dense_decomposition(spark):
    rows = [(k, *x) for k, x in enumerate(waves())]
    df = spark.createDataFrame(rows, "id int, rec string, ch int, kind int, waveform array<double>").repartition(5)
    axes = tp.principal_axes(df, ["rec", "ch"])
    got = tp.loadings(df, ["rec", "ch"], axes).collect()
    shares = {(x.ch, x.component): (x.size, x.share) for x in axes.collect()}
    for c in (0, 1):
        mine = sorted((x for x in got if x.ch == c), key=lambda x: x.id)
        m = np.array([x.waveform for x in mine])
        m -= m.mean(axis=1, keepdims=True)
        u, s, vt = np.linalg.svd(m, full_matrices=False)
        for k in (1, 2):
            assert shares[c, k] == (pytest.approx(s[k - 1]), pytest.approx(s[k - 1] ** 2 / (s**2).sum()))
            load = np.array([x[f"load_{k}"] for x in mine])
            assert np.allclose(load, u[:, k - 1] * np.sign(load @ u[:, k - 1]), atol=1e-9)


@pytest.mark.parametrize("method", ["pca", "shape"])
def test_templates_part_two_units(spark, method):
    df = spark.createDataFrame(waves(), "rec string, ch int, kind int, waveform array<double>")
    got = tp.spike_clusters(df, ["rec", "ch"], method, 12500.0).cache()
    rows = got.collect()
    assert len(rows) == 360
    by = {(x.ch, x.kind, x.template) for x in rows if x.template is not None}
    assert len({(c, t) for c, _, t in by}) == len(by) and all({k for c, k, _ in by if c == ch} == {0, 1} for ch in (0, 1))  # no cluster holds both units
    assert sum(x.template is None for x in rows) <= 18
    for x in tp.spike_templates(got, ["rec", "ch"]).collect():
        part = [y.waveform[x.i] for y in rows if (y.ch, y.template) == (x.ch, x.template)]
        assert (x.n, x.v) == (len(part), pytest.approx(float(np.median(part))))


def test_templates_of_poor_input(spark):
    kinds = "rec string, ch int, waveform array<double>"
    flat = spark.createDataFrame([("r", 0, [1.0, 1.0, 1.0])] * 3 + [("r", 1, None), ("r", 1, [1.0, None, 2.0])], kinds)
    assert tp.principal_axes(flat, ["rec", "ch"]).count() == 0
    assert {x.ch: x.template for x in tp.spike_clusters(flat, ["rec", "ch"], "pca", 1.0, 1).collect()} == {0: 1, 1: 1}
    empty = spark.createDataFrame([], kinds)
    assert tp.spike_templates(tp.spike_clusters(empty, ["rec", "ch"], "shape", 1.0, 1), ["rec", "ch"]).count() == 0
    with pytest.raises(ValueError):
        tp.spike_clusters(flat, ["rec"], "other", 1.0)
