"""Adaptive response curves against direct sums and their definition."""

import math

import numpy as np
import pytest

from axonlake.operators import rate_curves as rc
from axonlake.operators.stimulus import around


def gauss(x, w):
    return np.exp(-0.5 * (x / w) ** 2) / (math.sqrt(2 * math.pi) * w)


def direct(histogram, grid, widths):
    """Every sum written out: local costs by direct convolution, the widths for a stiffness, the balloon estimate and its cost."""
    step = grid[1] - grid[0]
    conv = lambda row, w: np.array([(row * gauss(t - grid, w)).sum() * step for t in grid])
    costs = [conv(histogram, w) ** 2 - 2 * conv(histogram, w) * histogram + 2 / (math.sqrt(2 * math.pi) * w) * histogram for w in widths]
    local = np.array([[widths[int(np.argmin([conv(c, window)[k] for c in costs]))] for k in range(len(grid))] for window in widths])

    def at(stiffness):
        chosen = []
        for k in range(len(grid)):
            ratios = [local[i, k] / widths[i] for i in range(len(widths))]
            if stiffness > max(ratios):
                chosen.append(widths[0])
            elif stiffness < min(ratios):
                chosen.append(widths[-1])
            else:
                chosen.append(stiffness * widths[max(i for i, r in enumerate(ratios) if r >= stiffness)])
        width = []
        for t in grid:
            z = [gauss(t - s, c / stiffness) for s, c in zip(grid, chosen)]
            width.append(sum(a * b for a, b in zip(chosen, z)) / sum(z))
        rate = np.array([sum(h * gauss(t - s, w) for s, h in zip(grid, histogram)) * step for t, w in zip(grid, width)])
        rate *= histogram.sum() / rate.sum()
        cost = sum((r * r - 2 * r * h + 2 / (math.sqrt(2 * math.pi) * w) * h) * step for r, h, w in zip(rate, histogram, width))
        return cost, rate, np.array(width)

    return local, at


@pytest.fixture(scope="module")
def case():
    r = np.random.RandomState(4)
    grid = np.linspace(-0.1, 0.3, 48)
    x = np.concatenate([r.uniform(-0.1, 0.3, 60), r.normal(0.04, 0.004, 90)])
    step = grid[1] - grid[0]
    histogram = np.bincount(np.clip(np.floor((x - grid[0]) / step + 0.5).astype(int), 0, 46), minlength=48) / step
    return histogram, grid, rc.width_candidates(step, 0.4, 12)


def test_smoothing_is_a_convolution(case):
    histogram, grid, widths = case
    step = grid[1] - grid[0]
    padded = np.zeros(600)
    padded[250:298] = histogram
    for w in widths[:6]:
        want = np.array([(padded * gauss((k - np.arange(600)) * step, w)).sum() * step for k in range(600)])
        assert np.abs(rc.smooth(padded, w / step) - want).max() < 1e-6 * want.max()


def test_costs_and_widths_against_direct_sums(case):
    histogram, grid, widths = case
    local, at = direct(histogram, grid, widths)
    curve = rc.StiffnessCurve(histogram, grid, widths, local)
    for g in (1e-12, 0.01, 0.1, 0.3, 0.7, 1.0):
        for mine, plain in zip(curve(g), at(g)):
            assert np.allclose(mine, plain, rtol=1e-9)
    found = rc.best_local_widths(histogram, widths, grid[1] - grid[0])
    assert (found[:4] == local[:4]).mean() > 0.95  # wide windows wrap at the ends of the padded grid


def test_search_finds_the_least_cost():
    r, grid = np.random.RandomState(4), np.linspace(-0.1, 0.3, 400)
    step = grid[1] - grid[0]
    x = np.concatenate([r.uniform(-0.1, 0.3, 600), r.normal(0.04, 0.006, 900)])
    histogram = np.bincount(np.floor((x - grid[0]) / step + 0.5).astype(int).clip(0, 398), minlength=400) / step
    widths = rc.width_candidates(step, 0.4, 40)
    curve = rc.StiffnessCurve(histogram, grid, widths, rc.best_local_widths(histogram, widths, step))
    cost, rate, width = rc.golden_section(curve, 1e-12, 1.0)
    assert cost <= min(curve(g)[0] for g in np.linspace(0.02, 1, 60)) + 0.02 * abs(cost)
    peak = np.abs(grid - 0.04).argmin()
    soft = curve(0.7)[2]
    assert soft[peak] < 0.3 * soft[-60]  # narrow at the burst, wide elsewhere
    assert rate[peak] == pytest.approx(rate.max(), rel=0.1)
    true = 600 / 0.4 + 900 * gauss(grid - 0.04, 0.006)
    assert np.abs(rate - true)[20:-20].mean() < 0.3 * true.mean()
    assert rc.golden_section(lambda x: ((x - 0.3) ** 2, x), 0, 1)[1] == pytest.approx(0.3, abs=1e-4)


def test_density_of_few_and_of_no_events():
    grid = np.linspace(0, 1, 200)
    for x in ([0.5], [0.2, 0.8], [0.1, 0.15, 0.2, 0.55, 0.9], list(np.arange(0, 1, 0.05))):
        density, width = rc.adaptive_density(np.array(x), np.ones(len(x)), grid)
        assert density.min() >= 0 and density.sum() * (grid[1] - grid[0]) == pytest.approx(1, abs=0.1) and (width > 0).all()
    assert not rc.adaptive_density(np.array([]), np.array([]), grid)[0].any()
    assert not rc.adaptive_density(np.array([1.0]), np.ones(1), grid)[0].any()  # the last point's cell is left out


def test_response_in_spark_equals_the_kernel(spark):
    r = np.random.RandomState(2)
    stim = [("a", 1, k, 10.0 * k) for k in range(1, 30)] + [("a", 2, k, 10.0 * k + 5) for k in range(1, 4)]
    ev = [("a", 0, float(10 * k + x)) for k in range(1, 30) for x in r.uniform(-0.1, 0.3, 9)] + [("a", 1, 10.0 * k + 0.02) for k in range(1, 30)] + [("a", 2, 15.05), ("a", 2, 25.1)]
    s, e = spark.createDataFrame(stim, "rec string, pattern int, trial int, ts double"), spark.createDataFrame(ev, "rec string, ch int, t double")
    got = {}
    for x in rc.adaptive_response(e, s, -0.1, 0.3, 60, 20).collect():
        got.setdefault((x.pattern, x.ch), {})[x.i] = (x.t, x.rate, x.width)
    assert set(got) == {(1, 0), (1, 1), (2, 2)} and all(len(v) == 60 for v in got.values())
    grid, step = np.linspace(-0.1, 0.3, 60), 0.4 / 59
    for (pattern, ch), rows in got.items():
        dt = sorted(x.dt for x in around(e, s, -0.1, 0.3).filter(f"pattern = {pattern} and ch = {ch}").collect())
        exact = len(set(dt)) <= 61
        x = np.array(dt) if exact else -0.1 + np.floor((np.array(dt) + 0.1) / step + 0.5) * step
        values, n = np.unique(x, return_counts=True)
        density, width = rc.adaptive_density(values, n.astype(float), grid, exact, 20)
        trials = {1: 29, 2: 3}[pattern]
        assert np.allclose([rows[i][1] for i in range(60)], density * len(dt) / trials) and np.allclose([rows[i][2] for i in range(60)], width)
    assert rc.adaptive_response(e.limit(0), s, -0.1, 0.3, 60).count() == 0
