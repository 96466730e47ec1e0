import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.operators import connectivity as conn
from axonlake.operators import events as ev
from axonlake.operators import joins, network, stimulus


def spikes(spark, trains):
    return spark.createDataFrame([("r", ch, float(t)) for ch, ts in trains.items() for t in ts], "rec string, ch long, t double")


def recordings(spark, duration):
    return spark.createDataFrame([("r", 1, float(duration))], "rec string, rec_no long, duration_s double")


def test_tiling_coefficient(spark):
    s, rec = spikes(spark, {1: [1, 2, 5], 2: [1.3, 5.2, 9.8], 3: [7.7]}), recordings(spark, 10)
    ta = {r.ch: r.ta for r in conn.tiled_fraction(s, rec, 0.5).collect()}
    assert ta[1] == pytest.approx(0.30) and ta[2] == pytest.approx(0.27)
    w = {(r.src, r.dst): r.w for r in conn.sttc(s, rec, 0.5).collect()}
    assert w == {(1, 2): pytest.approx(0.4710366, abs=1e-6)}
    every = {(r.src, r.dst): r.w for r in conn.sttc(s, rec, 0.5, positive_only=False).collect()}
    assert set(every) == {(1, 2), (1, 3), (2, 3)} and every[1, 3] < 0


def test_channel_bursts(spark):
    s = spikes(spark, {1: [1.00, 1.05, 1.09, 2.0, 3.00, 3.04, 3.08, 3.10, 5.0], 2: [1.0], 3: []})
    assert [(r.ch, r.t0, r.t1, r.n) for r in ev.bursts(s, 3, 0.1).collect()] == [(1, 3.00, 3.10, 4)]


def slow_bursts(t, n, th):
    """The scan, one event at a time."""
    crit = [any(j >= n - 1 and t[j] - t[j - n + 1] <= th for j in range(i, min(i + n, len(t)))) for i in range(len(t))]
    out, now = [], []
    for i in range(n - 1, len(t)):
        if not crit[i]:
            out.append(now)
            now = []
        elif len(now) >= n and t[i] - t[i - n + 1] > th:
            out.append(now)
            now = [t[i]]
        else:
            now.append(t[i])
    out.append(now)
    return [(b[0], b[-1], len(b)) for b in out if len(b) >= n]


def test_bursts_against_scan(spark):
    r = np.random.RandomState(0)
    trains = {c: np.round(np.cumsum(r.exponential(0.05 + 0.3 * (r.rand(120) < 0.2))), 4) for c in range(6)}
    got = sorted((x.ch, x.t0, x.t1, x.n) for x in ev.bursts(spikes(spark, trains), 4, 0.15).collect())
    assert got == sorted((c, *b) for c, t in trains.items() for b in slow_bursts(list(t), 4, 0.15))


def test_refractory(spark):
    df = spark.createDataFrame([("r", 1, f) for f in (10, 12, 15, 21, 22, 30, 34, 35, 36)], "rec string, ch long, frame long")
    assert sorted(r.frame for r in ev.refractory(df, 5).collect()) == [10, 21, 30, 36]


def test_runs_with_nulls(spark):
    df = spark.createDataFrame([(i, v) for i, v in enumerate([5, 5, 5, 7, 7, 5, None, None, 5])], "i long, v long").withColumn("k", F.lit(1))
    got = sorted((r.start, r.length, r.v) for r in ev.runs(df, ["k"], ["i"], "v").collect())
    assert [(a, b) for a, b, _ in got] == [(0, 3), (3, 2), (5, 1), (6, 2), (8, 1)]


def test_surrogate_cut(spark):
    df = spark.createDataFrame([("e", w) for w in (0.1, 0.2, 0.3, 0.4)] + [("z", 0.5)], "k string, w double")
    cut = {r.k: r.cut for r in conn.kth_smallest(df, ["k"], "w", 4, 0.25).collect()}
    assert cut == {"e": 0.3, "z": 0.0}


def test_trials(spark):
    s = spikes(spark, {1: [1.01, 1.02, 1.99, 2.015, 3.2]})
    stim = spark.createDataFrame([("r", 1, k, float(k)) for k in (1, 2, 3)], "rec string, pattern int, trial int, ts double")
    ch = spark.createDataFrame([("r", 1)], "rec string, ch long")
    n = stimulus.pre_post_counts(s, stim, ch, (-0.0295, 0.0), (0.0005, 0.03))
    assert stimulus.trial_proportion(n).first().proportion == pytest.approx(1 / 3)
    lat = {r.trial: r.latency_ms for r in stimulus.first_latency(s, stim, ch, 0.03).collect()}
    assert lat[1] == pytest.approx(10) and lat[2] == pytest.approx(15) and lat[3] is None


def test_as_of_and_intervals(spark):
    a = spikes(spark, {1: [0.5, 1.0, 1.5, 4.0]})
    b = spark.createDataFrame([("r", 1.0, "x"), ("r", 2.0, "y")], "rec string, t double, v string")
    look = lambda **k: {r.t: r.v for r in joins.as_of(a, b, ["rec"], "v", **k).collect()}
    assert look() == {0.5: None, 1.0: None, 1.5: "x", 4.0: "y"}
    assert look(strict=False) == {0.5: None, 1.0: "x", 1.5: "x", 4.0: "y"}
    assert look(forward=True) == {0.5: "x", 1.0: "y", 1.5: "y", 4.0: None}
    iv = spark.createDataFrame([("r", 0.9, 1.2), ("r", 1.1, 1.6), ("r", 5.0, 6.0)], "rec string, t0 double, t1 double")
    assert sorted(r.t for r in joins.outside_intervals(a, iv, ["rec"]).collect()) == [0.5, 4.0]


EDGES = [(1, 2, 0.5), (1, 3, 0.25), (2, 3, 1.0), (3, 4, 0.2)]


def test_network_metrics(spark):
    e = spark.createDataFrame([("r", *x) for x in EDGES], "rec string, src long, dst long, w double")
    k = ["rec"]
    d = {r.node: (r.degree, r.strength, r.mean_weight) for r in network.degrees(e, k).collect()}
    assert d[3] == (3, pytest.approx(1.45), pytest.approx(0.4833333)) and d[4] == (1, pytest.approx(0.2), pytest.approx(0.2))
    nodes = network.degrees(e, k)
    assert network.density(e, nodes, k).first().density == pytest.approx(2 / 3)
    cc = {r.node: r.cc for r in network.clustering(e, k).collect()}
    assert cc == {1: pytest.approx(0.5), 2: pytest.approx(0.5), 3: pytest.approx(1 / 6), 4: 0}
    p = network.shortest_paths(e, k)
    dist = {(r.src, r.dst): r.d for r in p.collect()}
    assert {x: dist[x] for x in ((1, 2), (1, 3), (1, 4), (2, 3), (2, 4), (3, 4))} == {(1, 2): 2, (1, 3): 3, (1, 4): 8, (2, 3): 1, (2, 4): 6, (3, 4): 5}
    m = network.path_metrics(p, nodes, k).first()
    assert m.path_length == pytest.approx(25 / 6) and m.global_efficiency == pytest.approx(0.3875)
    ne = {r.node: r.ne for r in network.nodal_efficiency(p, nodes.select("rec", "node"), k).collect()}
    assert ne == {1: pytest.approx(4 / 13), 2: pytest.approx(4 / 9), 3: pytest.approx(4 / 9), 4: pytest.approx(4 / 19)}
    c = spark.createDataFrame([("r", i, (i - 1) // 2) for i in (1, 2, 3, 4)], "rec string, node long, community long")
    pc = {r.node: r.pc for r in network.participation(e, c, k).collect()}
    assert pc == {1: pytest.approx(4 / 9), 2: pytest.approx(4 / 9), 3: pytest.approx(0.2378121), 4: pytest.approx(0, abs=1e-12)}
    assert network.modularity(e, c, k).first().q == pytest.approx(-0.1528600, abs=1e-6)


def test_null_networks_keep_degrees_and_weights(spark):
    from axonlake.operators import kernels

    r = np.random.RandomState(1)
    rows = [("r", i, j, float(r.rand())) for i in range(14) for j in range(i + 1, 14) if r.rand() < 0.4]
    e = spark.createDataFrame(rows, "rec string, src long, dst long, w double")
    want = sorted((x.node, x.degree) for x in network.degrees(e, ["rec"], 0.0).collect())
    for kind in ("swap", "strength", "lattice"):
        null = kernels.null_networks(e, ["rec"], 2, kind).collect()
        for rep in (1, 2):
            own = [x for x in null if x.rep == rep]
            assert sorted(x.w for x in own) == pytest.approx(sorted(x[3] for x in rows))
            part = spark.createDataFrame([("r", x.src, x.dst, x.w) for x in own], e.schema)
            assert sorted((x.node, x.degree) for x in network.degrees(part, ["rec"], 0.0).collect()) == want


def test_one_dimensional_split(spark):
    from axonlake.operators import stats

    df = spark.createDataFrame([(v,) for v in [0.0] * 5 + [10.0] * 5], "v double")
    assert stats.best_split(df, "v").first().boundary == 5
    assert stats.best_split(df.filter("v = 0"), "v").first().boundary is None
