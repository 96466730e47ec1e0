"""Measures of responses, communities and repeated designs against their definitions, written out plainly on small inputs."""

import itertools
import math

import numpy as np
import pytest

from axonlake.operators import graph_extra, network, signal, stats, stimulus

KEY = ["rec"]
POINTS, W0, W1, FWHM, SKIP = 61, -1.0, 2.0, 0.3, 0.2


def network_of(seed, n=9):
    rng = np.random.RandomState(seed)
    w = np.triu((rng.rand(n, n) < 0.5) * rng.randint(1, 9, (n, n)) / 8.0, 1)
    w[np.arange(n - 1), np.arange(1, n)] += 0.25
    return w + w.T


def edge_rows(w):
    return [("r", int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(np.triu(w)))]


def test_gateway(spark):
    w, of = network_of(4), np.array([0, 0, 0, 1, 1, 2, 2, 2, 3])
    k = w.sum(axis=1)
    most = max(k[of == m].sum() for m in range(4))
    want = []
    for i in range(len(w)):
        lost = 0.0
        for m in range(4):
            mine = w[i, of == m].sum()
            links = sum(w[a, b] for a in range(9) for b in range(9) if of[a] == of[i] and of[b] == m) / (2 if m == of[i] else 1)
            near = sum(k[j] for j in range(9) if of[j] == m and w[i, j] > 0)
            share = mine / links * near / most if (of == of[i]).sum() > 1 and links > 0 else 0.0
            lost += (mine / k[i] * (1 - share)) ** 2
        want.append(1 - lost)
    e = spark.createDataFrame(edge_rows(w), "rec string, src long, dst long, w double")
    c = spark.createDataFrame([("r", i, int(m)) for i, m in enumerate(of)], "rec string, node long, community int")
    got = {x.node: x.gateway for x in graph_extra.gateway(e, c, KEY).collect()}
    assert [got[i] for i in range(9)] == pytest.approx(want)
    assert graph_extra.gateway(e.limit(0), c, KEY).count() == 0


def test_participation_residual(spark):
    size, pc = [3, 3, 3, 2, 2, 1], [0.1, 0.4, 0.3, 0.6, None, 0.2]  # node 4 has no edge
    c = spark.createDataFrame([("r", i, s) for i, s in enumerate(size)], "rec string, node long, community int")
    p = spark.createDataFrame([("r", i, x) for i, x in enumerate(pc) if x is not None], "rec string, node long, pc double")
    y = np.array([x or 0.0 for x in pc])
    want = y - np.polyval(np.polyfit(size, y, 1), size)
    want[4] = 0
    assert [x.residual for x in graph_extra.participation_residual(p, c, KEY).orderBy("node").collect()] == pytest.approx(list(want))
    one = c.selectExpr("rec", "node", "0 AS community")
    assert {x.residual for x in graph_extra.participation_residual(p, one, KEY).collect()} == {0.0}


def test_weighted_agreement(spark):
    runs = {1: [0, 0, 1, 1], 2: [0, 1, 1, 1], 3: [0, 1, 0, 1]}
    p = spark.createDataFrame([("r", run, i, m) for run, of in runs.items() for i, m in enumerate(of)], "rec string, run int, node long, community int")
    weights = spark.createDataFrame([("r", 1, 2.0), ("r", 2, 1.0), ("r", 3, 1.0)], "rec string, run int, weight double")
    want = {(i, j): s for i, j in itertools.combinations(range(4), 2) if (s := sum(x / 4 for run, x in ((1, 2), (2, 1), (3, 1)) if runs[run][i] == runs[run][j]))}
    assert {(x.src, x.dst): x.n for x in network.agreement(p, KEY, weights=weights).collect()} == pytest.approx(want)


def test_cells_with_peaks(spark):
    rois = spark.createDataFrame([("r", 1, True), ("r", 2, False), ("r", 3, True), ("r", 4, None), ("s", 3, True)], "rec string, roi long, is_cell boolean")
    peaks = spark.createDataFrame([("r", 3, 5.0), ("r", 3, 9.0), ("r", 2, 1.0)], "rec string, roi long, t double")
    assert sorted((x.rec, x.roi) for x in signal.keep_cells(rois).collect()) == [("r", 1), ("r", 3), ("s", 3)]
    assert [(x.rec, x.roi) for x in signal.keep_cells(rois, peaks).collect()] == [("r", 3)]


def test_two_way_repeated_anova(spark):
    x = np.random.RandomState(3).randn(5, 3, 2) + np.arange(3)[None, :, None]
    rows = [("m", s, a, b, float(x[s, a, b] + d)) for s in range(5) for a in range(3) for b in range(2) for d in (-0.5, 0.5)] + [("m", 9, 0, 0, 50.0), ("m", 0, 1, 1, None)]
    df = spark.createDataFrame(rows, "metric string, subject long, age int, side int, value double")
    g, mean = x.mean(), lambda *axes: x.mean(axis=axes, keepdims=True)
    a, b, s = mean(0, 2), mean(0, 1), mean(1, 2)
    ab, sa, sb = mean(0), mean(2), mean(1)
    ss = lambda z: float((np.broadcast_to(z, x.shape) ** 2).sum())
    want = {
        "age": (ss(a - g) / 2 / (ss(sa - s - a + g) / 8), 2, 8), "side": (ss(b - g) / (ss(sb - s - b + g) / 4), 1, 4),
        "age:side": (ss(ab - a - b + g) / 2 / (ss(x - ab - sa - sb + a + b + s - g) / 8), 2, 8),
    }
    got = {r.effect: (r.f, r.df1, r.df2) for r in stats.two_way_repeated_anova(df, ["metric"], "subject", "age", "side").collect()}
    assert set(got) == set(want) and all(got[k] == pytest.approx(want[k]) for k in want)
    assert stats.two_way_repeated_anova(df.filter("subject = 9"), ["metric"], "subject", "age", "side").filter("f is not null").count() == 0


def test_t_interval(spark):
    assert [stats.t_quantile(p, n) for p, n in ((0.05, 1), (0.05, 4), (0.01, 10), (0.1, 30))] == pytest.approx([12.7062, 2.77645, 3.16927, 1.69726], rel=1e-5)
    df = spark.createDataFrame([("a", x) for x in (1.0, 2.0, 4.0, 7.0, 9.0)] + [("b", 1.0), ("c", None)], "m string, value double")
    got = {x.m: x for x in stats.t_interval(df, ["m"]).collect()}
    assert got["a"].half == pytest.approx(2.77645 * np.std([1, 2, 4, 7, 9], ddof=1) / math.sqrt(5), rel=1e-5)
    assert got["b"].half is None and got["c"].half is None


def test_onsets_by_median_z(spark):
    v = np.random.RandomState(0).randn(200)
    v[[5, 60, 62, 150]] = 40.0
    samples = spark.createDataFrame([("r", 1, i, float(x)) for i, x in enumerate(v)] + [("r", 2, i, 1.0) for i in range(50)], "rec string, ch long, frame long, v double")
    template = spark.createDataFrame([("r", 1.0), ("r", 5.9), ("r", 15.1), ("s", 14.0)], "rec string, ts double")
    # at 10 frames a second the onsets are 0.6 (none before), 6.1 (6.3 falls in its refractory time) and 15.1 (not before itself)
    assert sorted((x.ch, x.ts) for x in stimulus.onsets_by_median_z(samples, template, 15.0, 5, 10.0).collect()) == [(1, 5.9), (1, 5.9)]
    assert stimulus.onsets_by_median_z(samples, template.limit(0), 15.0, 5, 10.0).count() == 0


def plain_curve(offsets, trials, lo, hi):
    step, sigma = (hi - lo) / (POINTS - 1), FWHM / (2 * math.sqrt(2 * math.log(2)))
    half = round(2 * 5 * sigma / step) // 2
    kernel = [math.exp(-0.5 * (k * step / sigma) ** 2) for k in range(-half, half + 1)]
    out = np.zeros(POINTS)
    for x in offsets:
        for k in range(-half, half + 1):
            if 0 <= (i := round((x - lo) / step) + k) < POINTS:
                out[i] += kernel[k + half] / (sum(kernel) * step) / trials
    return out, lo + step * np.arange(POINTS)


def area(y, t):
    return float(((y[1:] + y[:-1]) / 2 * np.diff(t)).sum())


def test_response_table(spark):
    rng = np.random.RandomState(2)
    trials = [100.0, 104.0, 109.5, 115.25]
    trains = {0: trials, 1: sorted(rng.uniform(20, 120, 300)), 2: sorted([t + x for t in trials for x in (0.21, 0.52, 0.55, 1.33)] + [99.1]), 3: [5.0], 4: [99.55]}
    spikes = spark.createDataFrame([("r", c, float(t)) for c, ts in trains.items() for t in ts], "rec string, ch long, t double")
    stim = spark.createDataFrame([("r", 7, i, t) for i, t in enumerate(trials)], "rec string, pattern int, trial int, ts double")
    channels = spark.createDataFrame([("r", c) for c in range(6)], "rec string, ch long")
    got = stimulus.response_table(spikes, stim, channels, W0, W1, SKIP, FWHM, POINTS, 3, stimulated=channels.filter("ch = 0"))
    rows = {x.ch: x for x in got.collect()}
    assert sorted(rows) == [1, 2, 4]  # 0 is stimulated, 3 has no event in the window, 5 none at all
    for c, x in rows.items():
        ts = np.array(trains[c])
        inside = lambda lo, hi, shut=True: np.concatenate([(d := ts - s)[(d >= lo) & ((d <= hi) if shut else (d < hi))] for s in trials])
        y, t = plain_curve(inside(W0, W1), 4, W0, W1)
        on = t >= -1e-9
        base = []
        for k in (1, 2, 3):
            d = np.concatenate([ts - (s - k * W1) for s in trials])
            base.append(area(*plain_curve(d[(d > W0 + SKIP) & (d <= W0 + W1)], 4, W0, W0 + W1)))
        assert x.auc == pytest.approx(area(y[on], t[on])) and x.auc_baseline == pytest.approx(np.mean(base)) and x.auc_corrected == pytest.approx(x.auc - x.auc_baseline)
        assert x.peak_rate == pytest.approx(y[on].max()) and x.peak_ms == pytest.approx(1000 * t[on][np.argmax(y[on])], abs=1e-6)
        first = int(np.argmax(y))
        low = [i for i in range(first, POINTS) if y[i] <= y[first] / 2]
        assert x.half_ms == (pytest.approx(1000 * t[low[0]], abs=1e-6) if low else None)
        span = W1 - SKIP
        rate = lambda lo, hi: np.array([((ts - s >= lo) & (ts - s < hi)).sum() / span for s in trials])
        pre, post = rate(-span, 0.0), rate(SKIP, W1)
        if pre.std() or post.std():
            assert x.d_prime == pytest.approx((post.mean() - pre.mean()) / math.sqrt((pre.var(ddof=1) + post.var(ddof=1)) / 2))
        late = [1000 * d[d > 0].min() for s in trials if ((d := ts - s)[(d > 0) & (d <= W1)]).size]
        assert x.median_latency_ms == (pytest.approx(np.median(late)) if late else None)
        assert (x.window_start, x.window_end) == (W0, W1)
