"""Filters, smoothing, aligned waveforms, array bursts, rosters and directed cores against plain versions."""

import numpy as np
import pytest

from axonlake.operators import events as ev
from axonlake.operators import graph_extra, network, signal
from axonlake.sources import tables


def recurrence(x, sections):
    """Sample by sample."""
    for b0, b1, b2, a1, a2 in sections:
        x1 = x2 = y1 = y2 = 0.0
        out = []
        for v in x:
            y = b0 * v + b1 * x1 + b2 * x2 - a1 * y1 - a2 * y2
            x1, x2, y1, y2 = v, x1, y, y1
            out.append(y)
        x = out
    return np.array(x)


@pytest.mark.parametrize("n", [0, 1, 2, 5, 24, 1000, 1003])
def test_filter_in_blocks_is_the_recurrence(n):
    x = np.random.RandomState(n).normal(0, 10, n)
    for lo, hi, fs in ((60.0, 300.0, 1000.0), (600.0, 8000.0, 25000.0)):
        sections = signal.butter_bandpass(lo, hi, fs)
        assert np.allclose(signal._sos(x, sections), recurrence(x, sections), atol=1e-8)


def test_bandpass_in_chunks_is_the_whole_filter(spark):
    x = np.random.RandomState(5).normal(0, 10, 3000)
    s = signal.butter_bandpass(60.0, 300.0, 1000.0)
    whole = recurrence(recurrence(x, s)[::-1], s)[::-1]
    got = signal.bandpass(spark.createDataFrame([("r", 0, i, float(v)) for i, v in enumerate(x)], "rec string, ch int, frame long, v double"), 60.0, 300.0, 1000.0, 700).orderBy("frame").collect()
    assert [r.frame for r in got] == list(range(3000))
    assert np.allclose([r.v for r in got], whole, atol=1e-3)


def test_savitzky_golay(spark):
    r = np.random.RandomState(6)
    series = {"long": r.normal(0, 1, 40), "exact": r.normal(0, 1, 9), "short": r.normal(0, 1, 8)}
    rows = [(k, i, float(v), "kept") for k, x in series.items() for i, v in enumerate(x)]
    got = signal.savitzky_golay(spark.createDataFrame(rows, "rec string, frame int, v double, other string"), ["rec"], "frame", "v", 9, 3)
    assert got.columns == ["rec", "frame", "v", "other", "smooth"]
    found = {(x.rec, x.frame): x.smooth for x in got.collect()}
    assert len(found) == len(rows)
    for k, x in series.items():
        for i in range(len(x)):
            if len(x) < 9:
                assert found[k, i] is None
                continue
            mid = min(max(i, 4), len(x) - 5)
            at = np.arange(mid - 4, mid + 5)
            assert found[k, i] == pytest.approx(np.polyval(np.polyfit(at - mid, x[at], 3), i - mid), abs=1e-9)


def test_aligned_waveforms(spark):
    r = np.random.RandomState(7)
    x = r.normal(0, 1, 1500)
    for at in (10, 200, 400, 405, 700, 1490):
        x[at] = -30 - at / 100
    x[900], x[1100] = -400.0, -30.0  # an artefact, and a peak beside one upwards
    x[1110] = 90.0
    events = [198, 204, 402, 407, 699, 905, 1102, 12, 1491, 1300]
    kinds = "rec string, ch int, frame long, v double"
    s = spark.createDataFrame([("r", 0, i, float(v)) for i, v in enumerate(x)], kinds)
    e = spark.createDataFrame([("r", 0, f) for f in events], "rec string, ch int, frame long")
    sd = np.median(np.abs(x - x.mean())) / 0.6745
    want = {}
    for f in events:
        near = range(max(0, f - 10), min(len(x), f + 11))
        p = min(near, key=lambda i: (x[i], i))
        if -100 * sd <= x[p] <= -5 * sd and p >= 25 and p + 25 < len(x) and x[p - 25 : p + 26].max() <= 15 * sd:
            want[p] = list(x[p - 25 : p + 26])
    assert set(want) == {200, 405, 700}
    assert {r.frame: r.waveform for r in signal.align_peaks(e, s).collect()} == want


def test_array_bursts(spark):
    r = np.random.RandomState(8)
    trains = {("a", c): np.sort(np.concatenate([r.uniform(0, 600, 25), *(u + np.cumsum(r.uniform(0.01, 0.05, 12)) for u in r.uniform(0, 600, 2 + c))])) for c in range(3)}
    trains["a", 3] = np.array([10.0, 200.0, 400.0])
    trains["quiet", 0] = np.array([1.0, 300.0])
    spikes = spark.createDataFrame([(a, c, float(t)) for (a, c), ts in trains.items() for t in ts], "rec string, ch int, t double")
    rec = spark.createDataFrame([("a", 600.0), ("quiet", 600.0), ("empty", 600.0)], "rec string, duration_s double")
    found = ev.bursts(spikes, 5, 0.5).cache()
    got = {x.rec: x for x in ev.array_bursts(spikes, found, rec).collect()}
    assert set(got) == {"a", "quiet", "empty"}
    each, inside_all = [], 0
    for c in range(4):
        t, b = trains["a", c], [(x.t0, x.t1, x.n) for x in found.collect() if (x.rec, x.ch) == ("a", c)]
        if not b:
            continue
        parts = [t[(t >= t0) & (t <= t1)] for t0, t1, _ in b]
        out = np.array([v for v in t if not any(t0 <= v <= t1 for t0, t1, _ in b)])
        assert [len(p) for p in parts] == [n for *_, n in b]
        inside_all += sum(map(len, parts))
        each.append((c, len(b) / 10, np.mean([len(p) / (p[-1] - p[0]) for p in parts]), np.mean([p[-1] - p[0] for p in parts]) * 1e3, np.mean([np.diff(p).mean() for p in parts]) * 1e3, np.diff(out).mean() * 1e3))
    a = got["a"]
    assert a.bursting == [c for c, *_ in each] and len(each) == 3
    for k, name in enumerate(("burst_rate", "in_burst_rate", "duration_ms", "isi_in_ms", "isi_out_ms")):
        assert a[name] == pytest.approx(np.median([v[k + 1] for v in each]))
    assert a.fraction == pytest.approx(inside_all / sum(len(t) for (r_, _), t in trains.items() if r_ == "a"))
    assert (got["quiet"].bursting, got["quiet"].burst_rate, got["quiet"].fraction) == ([], None, 0.0)
    assert (got["empty"].bursting, got["empty"].duration_ms, got["empty"].fraction) == ([], None, None)


def test_skeleton_roster(spark):
    names = spark.createDataFrame([("NGN_DIV14_A", 1), (" NGN_DIV14_A ", 2), ("plain", 3), ("  ", 4), (None, 5)], "rec string, other int")
    got = {x.rec: x for x in tables.skeleton_roster(names).collect()}
    assert {k: x.div for k, x in got.items()} == {"NGN_DIV14_A": 14.0, "plain": None}
    assert all((x.grp, x.ground) == ("", []) for x in got.values())


def test_directed_core_and_rich_club(spark):
    r = np.random.RandomState(9)
    nets = {k: {(int(a), int(b)) for a, b in r.randint(0, 14, (n, 2)) if a != b} for k, n in (("thin", 20), ("thick", 90))}
    arcs = spark.createDataFrame([(k, a, b, 1.0) for k, e in nets.items() for a, b in e], "rec string, src int, dst int, w double")
    core = {(x.rec, x.src, x.dst) for x in network.k_core(arcs, ["rec"], 7).collect()}
    club = {(x.rec, x.k): (x.nodes, x.links, x.share) for x in graph_extra.binary_rich_club(arcs, ["rec"], directed=True).collect()}
    for name, e in nets.items():
        degree = lambda edges, v: sum((a == v) + (b == v) for a, b in edges)
        left = set(e)
        while low := {v for a in left for v in a if degree(left, v) < 7}:
            left = {(a, b) for a, b in left if a not in low and b not in low}
        assert {(a, b) for k, a, b in core if k == name} == left
        for k in range(max(degree(e, v) for v in range(14))):
            top = {v for v in range(14) if degree(e, v) > k}
            links = sum(a in top and b in top for a, b in e)
            nodes, n, share = club[name, k]
            assert (nodes, n) == (len(top), links) and (share is None if len(top) < 2 else share == pytest.approx(links / (len(top) * (len(top) - 1))))
    assert any(k == "thick" for k, *_ in core)


@pytest.fixture(scope="module")
def array(spark):
    """Trains of six channels with array-wide bursts, as rows and as a table."""
    r = np.random.RandomState(11)
    rows = [("a", c, float(t)) for c in range(6) for t in r.uniform(0, 300, 40)]
    rows += [("a", int(c), float(u + v)) for u in r.uniform(0, 290, 12) for c in r.choice(6, r.randint(1, 6), replace=False) for v in r.uniform(0, 0.4, 6)]
    rows += [("b", 0, 5.0), ("b", 1, 5.0), ("b", 1, 7.0)]
    return rows, spark.createDataFrame(rows, "rec string, ch int, t double").cache(), spark.createDataFrame([("a", 300.0), ("b", 300.0), ("none", 300.0)], "rec string, duration_s double")


def test_network_bursts_and_summary(spark, array):
    rows, spikes, rec = array
    pooled = spark.createDataFrame([("a", t) for t in sorted({t for k, _, t in rows if k == "a"})], "rec string, t double")
    every = [(x.t0, x.t1, x.n) for x in ev.bursts(pooled, 8, 0.6, ["rec"]).collect()]
    want = {}
    for t0, t1, n in every:
        chs = {c for k, c, t in rows if k == "a" and t0 <= t <= t1}
        if len(chs) >= 3:
            want[t0] = (t1, n, len(chs))
    found = ev.network_bursts(spikes, 8, 0.6, 3).cache()
    assert {x.t0: (x.t1, x.n, x.channels) for x in found.collect()} == want and 3 <= len(want) < len(every)
    got = {x.rec: x for x in ev.burst_summary(spikes, found, rec).collect()}
    starts = sorted(want)
    gaps = np.array([b - want[a][0] for a, b in zip(starts, starts[1:])])
    mine = [(k, t) for k, _, t in rows if k == "a"]
    a = got["a"]
    assert (a.n_bursts, a.burst_rate) == (len(want), pytest.approx(len(want) / 5))
    assert a.mean_length == pytest.approx(np.mean([want[s][0] - s for s in starts]))
    assert a.mean_channels == pytest.approx(np.mean([want[s][2] for s in starts]))
    assert a.cv_ibi == pytest.approx(gaps.std(ddof=1) / gaps.mean())
    assert a.fraction_in_bursts == pytest.approx(sum(any(s <= t <= want[s][0] for s in starts) for _, t in mine) / len(mine))
    assert (got["b"].n_bursts, got["b"].mean_length, got["b"].fraction_in_bursts) == (0, None, 0.0)
    assert (got["none"].n_bursts, got["none"].fraction_in_bursts) == (0, None)


def test_zscore_bursts(spark, array):
    rows, spikes, rec = array
    channels = spark.createDataFrame([(k, c) for k in ("a", "b") for c in range(7)], "rec string, ch int")
    got = {(x.rec, x.bin): x.z for x in ev.zscore_bursts(spikes, channels, rec, 2.0, 0.4).collect()}
    want = {}
    for k in ("a", "b"):
        z = np.zeros(150)
        for c in range(7):
            n = np.bincount([int(t // 2) for r_, ch, t in rows if (r_, ch) == (k, c)], minlength=150).astype(float)
            if n.std():
                z += (n - n.mean()) / n.std(ddof=1) / 7  # a silent channel adds nothing
        edge = np.concatenate([[-np.inf], z, [-np.inf]])
        want |= {(k, i): z[i] for i in range(150) if z[i] >= 0.4 and edge[i] < z[i] - 1e-12 and edge[i + 2] <= z[i] + 1e-12}
    assert got == {k: pytest.approx(v) for k, v in want.items()} and len(want) > 3


def plain_gap_threshold(t, cap=0.1):
    """Spans of four events: the valley between the first two peaks of the smoothed histogram of their logarithms."""
    if len(set(np.diff(t))) <= 10:
        return cap
    h = np.histogram(np.log10((t[3:] - t[:-3]) * 1000), bins=-5 + 0.05 * np.arange(131))[0].astype(float)
    line = np.round([np.polyval(np.polyfit(np.arange(9), h[lo : lo + 9], 1), i - lo) for i in range(130) for lo in [min(max(i - 4, 0), 121)]], 9)
    tops = [i for i in range(1, 129) if line[i - 1] < line[i] >= line[i + 1] and line[i] > 0]
    apart = [p for i, p in enumerate(tops) if not i or p - tops[i - 1] >= 2]
    if len(apart) < 2:
        return 0.0 if np.diff(t).max() < cap else cap
    return min(cap, 10 ** (0.05 * min(range(apart[0], apart[1] + 1), key=lambda i: (line[i], i)) - 5) / 1000)


def test_automatic_gap_threshold(spark):
    r = np.random.RandomState(12)
    two = np.cumsum(np.where(r.rand(3000) < 0.02, r.lognormal(np.log(0.012), 0.2, 3000), r.lognormal(np.log(0.0002), 0.3, 3000)))
    trains = {0: two, 1: np.arange(8) * 0.5, 2: np.cumsum(r.lognormal(np.log(0.005), 0.05, 500)), 3: np.cumsum(r.lognormal(np.log(5.0), 0.05, 500))}
    spikes = spark.createDataFrame([("a", c, float(t)) for c, ts in trains.items() for t in ts], "rec string, ch int, t double")
    got = {x.ch: x.threshold for x in ev.automatic_gap_threshold(spikes, 4).collect()}
    assert got == {c: pytest.approx(plain_gap_threshold(t)) for c, t in trains.items()}
    assert got[1] == 0.1 and got[3] == 0.1 and 0.0006 < got[0] < 0.012
