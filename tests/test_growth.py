"""Steps whose work must grow with their input: dense inputs on which pairs of near rows would be too many, and the results by plain loops."""

import random

from axonlake.operators import connectivity, joins

KEY = ["rec"]


def test_forward_look_up_has_a_growing_frame(spark):
    rng = random.Random(3)
    a, b = [rng.randrange(200) / 4 for _ in range(300)], sorted({rng.randrange(200) / 4 for _ in range(60)})
    left = spark.createDataFrame([("r", t) for t in a], "rec string, t double")
    right = spark.createDataFrame([("r", t, t) for t in b], "rec string, t double, v double")
    for strict in (True, False):
        df = joins.as_of(left, right, KEY, "v", strict=strict, forward=True)
        want = sorted((t, min((x for x in b if x > t or (not strict and x == t)), default=-1.0)) for t in a)
        assert sorted((r.t, -1.0 if r.v is None else r.v) for r in df.collect()) == want
        assert "unboundedfollowing" not in df._jdf.queryExecution().toString().lower()


def test_coincidences_of_dense_trains(spark):
    """Two channels of 60,000 events within one bucket each way: 3.6e9 near pairs, one row of each channel to meet."""
    ids = spark.range(120_000)
    dense = ids.selectExpr("'r' rec", "id % 2 ch", "id / 1e5 t")
    assert {(x.a, x.b): x.hits for x in connectivity.coincidences(dense, 2.0).collect()} == {(0, 1): 60_000, (1, 0): 60_000}


def test_coincidences_match_all_pairs(spark):
    rng = random.Random(5)
    rows = sorted({("r", rng.randrange(4), rng.randrange(400) / 8) for _ in range(150)}) + [("s", 1, 0.5)]
    for dt in (0.125, 0.5, 3.0):
        want = {}
        for rec, a, t in rows:
            for b in {c for r, c, u in rows if r == rec and c != a and abs(u - t) <= dt}:
                want[rec, a, b] = want.get((rec, a, b), 0) + 1
        got = connectivity.coincidences(spark.createDataFrame(rows, "rec string, ch long, t double"), dt).collect()
        assert {(x.rec, x.a, x.b): x.hits for x in got} == want


def test_spans_of_a_dense_train_are_few():
    import numpy as np

    rng = np.random.default_rng(2)
    for near in (0, 1, 7):
        x, y = (np.unique(rng.integers(0, 500, 60)) for _ in range(2))
        first, last = connectivity._spans(x, near)
        assert (np.searchsorted(y, last, "right") - np.searchsorted(y, first, "left")).sum() == sum(np.abs(x - v).min() <= near for v in y)
    assert len(connectivity._spans(np.arange(100_000), 1)[0]) == 1
    for by in (1, 200, 500):
        moved = np.array([0, 3, 250, 499, 500]) + by
        assert connectivity._turned(np.array([0, 3, 250, 499, 500]), by, 500).tolist() == sorted({int(v - 500 if v > 500 else v) for v in moved})


def test_motifs_of_a_star_list_no_triples(spark):
    """A hub of 40,000 neighbours has 8e8 open triples, all of one pattern."""
    from axonlake.operators import network

    n = 40_000
    arcs = spark.range(1, n + 1).selectExpr("'r' rec", "0L src", "id dst", "2.0D w")
    assert [x.n for x in network.motifs3(arcs, KEY).collect()] == [n * (n - 1) // 2]
    for functional in (False, True):
        rows = network.weighted_motifs3(arcs, KEY, functional).selectExpr("node = 0 hub", "n", "round(intensity, 3) i", "round(coherence, 3) c").distinct().collect()
        assert sorted(tuple(r) for r in rows) == [(False, n - 1, 2.0 * (n - 1), 1.0 * (n - 1)), (True, n * (n - 1) // 2, 1.0 * n * (n - 1), n * (n - 1) / 2)]


def test_triples_match_all_threes(spark):
    from itertools import combinations

    from axonlake.operators import network

    rng = random.Random(8)
    pairs = {p for p in combinations(range(25), 2) if rng.random() < 0.3}
    df = spark.createDataFrame([("r", *p) for p in pairs], "rec string, u long, v long")
    want = [t for t in combinations(range(25), 3) if pairs.issuperset(combinations(t, 2))]
    assert sorted((x.a, x.b, x.c) for x in network._triples(df, KEY).collect()) == want


def test_distances_in_blocks_of_sources(spark, monkeypatch):
    """Several components and blocks; a ring of 300 nodes, whose ways took more rounds of joins than were allowed for hops."""
    import math

    from axonlake.operators import graph_extra, kernels, network

    monkeypatch.setattr(kernels, "GROUP_DISTANCES", 30_000)
    rng = random.Random(4)
    arcs = {("r", i, (i + 1) % 300): 1.0 for i in range(300)} | {("r", 1000 + i, 1000 + j): rng.choice([0.5, 1.0, 2.0]) for i in range(30) for j in range(30) if i < j and rng.random() < 0.1} | {("s", 1, 2): 4.0}
    df = spark.createDataFrame([(*k, w) for k, w in arcs.items()], "rec string, src long, dst long, w double")

    def plain(steps):
        out = {}
        for start in {x[:2] for x in steps}:
            best, todo = {start[1]: 0.0}, [start[1]]
            while todo:
                u = todo.pop(0)
                for (_, _, v), w in ((x, w) for x, w in steps.items() if x[:2] == (start[0], u)):
                    if best[u] + w < best.get(v, math.inf):
                        best[v] = best[u] + w
                        todo.append(v)
            out |= {(*start, v): d for v, d in best.items() if v != start[1]}
        return out

    some = {k: w for k, w in arcs.items() if k[1] >= 1000 or k[0] == "s"}
    got = {(x.rec, x.src, x.dst): x.d for x in graph_extra.hops(df, KEY).collect()}
    ring = {k: d for k, d in got.items() if k[0] == "r" and k[1] < 1000}
    assert ring == {("r", i, j): (j - i) % 300 for i in range(300) for j in range(300) if i != j}
    assert {k: d for k, d in got.items() if k not in ring} == plain({k: 1 for k in some})
    got = {(x.rec, x.src, x.dst): round(x.d, 9) for x in network.shortest_paths(df, KEY).collect()}
    assert all(got["r", i, j] == min((j - i) % 300, (i - j) % 300) for i in range(0, 300, 7) for j in range(300) if i != j)
    assert {k: d for k, d in got.items() if k[0] == "s" or k[1] >= 1000} == plain({k: 1 / w for k, w in some.items()} | {(k[0], k[2], k[1]): 1 / w for k, w in some.items()})


def test_shuffle_null_and_window_counts(spark):
    from axonlake.functions.scalars import mixed
    from axonlake.operators import stimulus

    rng = random.Random(9)
    trains = {ch: sorted(rng.randrange(400) / 2 for _ in range(40)) for ch in (0, 1)}
    onsets = sorted(rng.sample(range(20, 180), 12))
    spikes = spark.createDataFrame([("r", ch, t) for ch, x in trains.items() for t in x], "rec string, ch long, t double")
    stim = spark.createDataFrame([("r", 1, i, float(t)) for i, t in enumerate(onsets)], "rec string, pattern int, trial int, ts double")
    chans = spark.createDataFrame([("r", ch) for ch in (0, 1, 2)], "rec string, ch long")
    recs = spark.createDataFrame([("r", 7, 200.0)], "rec string, rec_no long, duration_s double")
    pre, post = (-10.0, 0.0), (1.0, 11.0)
    inside = lambda x, ts, w: sum(w[0] <= t - ts < w[1] for t in x)
    counts = {(x.trial, x.ch): (x.pre, x.post) for x in stimulus.pre_post_counts(spikes, stim, chans, pre, post).collect()}
    assert counts == {(i, ch): tuple(inside(trains.get(ch, []), ts, w) for w in (pre, post)) for i, ts in enumerate(onsets) for ch in (0, 1, 2)}
    got = {(x.trial, x.ch): (x.n, x.latency_ms) for x in stimulus.trial_counts(spikes, stim, chans, 8.0).collect()}
    near = {(i, ch): [t - ts for t in trains.get(ch, []) if 0 < t - ts <= 8] for i, ts in enumerate(onsets) for ch in (0, 1, 2)}
    assert got == {k: (len(v), min(v) * 1000 if v else None) for k, v in near.items()}
    from pyspark.sql import functions as F

    by = {(x.ch, x.id): x.by for x in chans.crossJoin(spark.range(1, 8)).select("ch", "id", F.pmod(mixed(F.lit(3), F.lit(7), F.col("ch"), F.col("id")), F.lit(200)).alias("by")).collect()}
    want = {}
    for (ch, rep), shift in by.items():
        x = [t + shift - 200 if t + shift > 200 else t + shift for t in trains.get(ch, [])]
        want[ch, rep] = sum(inside(x, ts, post) > inside(x, ts, pre) for ts in onsets) / len(onsets)
    null = stimulus.shuffled_proportions(spikes, stim, chans, recs, pre, post, 7, 1.0, 3, block=3)
    assert {(x.ch, x.rep): x.proportion for x in null.collect()} == want


def test_trial_counts_pair_no_events(spark):
    """20,000 trials whose windows hold all of 20,000 events: 4e8 pairs."""
    from axonlake.operators import stimulus

    x = spark.range(20_000).selectExpr("'r' rec", "1 pattern", "id trial", "id / 1e4 ts")
    n = stimulus.trial_counts(x.selectExpr("rec", "0L ch", "ts + 5 t"), x, spark.createDataFrame([("r", 0)], "rec string, ch long"), 10.0)
    assert [tuple(r) for r in n.groupBy("n").count().collect()] == [(20_000, 20_000)]


def test_offset_cells_match_pairs(spark):
    from axonlake.operators import stimulus

    rng = random.Random(6)
    trains = {ch: [rng.random() * 50 for _ in range(60)] for ch in (0, 1)}
    onsets = {1: [rng.random() * 50 for _ in range(15)], 2: [10.0, 30.0]}
    spikes = spark.createDataFrame([("r", ch, t) for ch, x in trains.items() for t in x], "rec string, ch long, t double")
    stim = spark.createDataFrame([("r", p, i, t) for p, x in onsets.items() for i, t in enumerate(x)], "rec string, pattern int, trial int, ts double")
    apart = {(p, ch): sorted(t - ts for t in trains[ch] for ts in x if -1.5 <= t - ts <= 4) for p, x in onsets.items() for ch in trains}
    for skip, most in ((0.0, 0), (0.7, 0), (0.0, 20)):
        want = {}
        for (p, ch), x in apart.items():
            for dt in x:
                if not skip or dt > -1.5 + skip:
                    k = (p, ch, None, dt) if len(x) <= most else (p, ch, int((dt + 1.5) / 0.5 + 0.5), None)
                    want[k] = want.get(k, 0) + 1
        got = stimulus.offset_cells(spikes, stim, -1.5, 4.0, 12, skip, most).collect()
        assert {(x.pattern, x.ch, x.i, x.x): x.n for x in got} == want
    dense = spark.range(20_000).selectExpr("'r' rec", "1 pattern", "id trial", "0L ch", "id / 1e4 ts", "id / 1e4 + 5 t")
    assert sum(x.n for x in stimulus.offset_cells(dense, dense, 0.0, 10.0, 2).collect()) == 400_000_000


def test_common_neighbours_are_shuffled_as_lists(spark):
    import re
    from itertools import combinations

    from axonlake.operators import network

    rng = random.Random(1)
    pairs = {p for p in combinations(range(30), 2) if rng.random() < 0.15}
    near = {x: {v for p in pairs if x in p for v in p if v != x} for x in range(30)}
    df = spark.createDataFrame([("r", *p, 1.0) for p in pairs], "rec string, src long, dst long, w double")
    got = network._common(df, KEY)
    want = {(x, y): (len(near[x]), len(near[y]), len(near[x] & near[y]), int((x, y) in pairs)) for x, y in combinations(range(30), 2) if near[x] & near[y] or (x, y) in pairs}
    assert {(x.src, x.dst): (x.da, x.db, x.c, x.a) for x in got.collect()} == want
    assert not re.search(r"hashpartitioning\(rec#\d+, src#\d+L?, dst#", network.matching_index(df, KEY)._jdf.queryExecution().executedPlan().toString())


def test_agreement_shuffles_no_pairs(spark):
    """Copies, nulls and repeated rows by plain loops; what is listed of pairs of nodes meets no join, shuffle or aggregate."""
    from axonlake.operators import network

    rng = random.Random(8)
    rows = [(rng.choice("rs"), rng.randrange(3), rng.choice([*range(40), None]), rng.choice([0, 1, 2, None])) for _ in range(300)]
    p = spark.createDataFrame(rows, "rec string, run int, node long, community int")
    want = {}
    for a in rows:
        for b in rows:
            if a[:2] == b[:2] and a[3] == b[3] and None not in (a[2], a[3], b[2]) and a[2] < b[2]:
                want[a[0], a[2], b[2]] = want.get((a[0], a[2], b[2]), 0) + 1
    for chunk in (2, 4000):
        got = network.agreement(p, KEY, chunk=chunk)
        assert sorted((x.rec, x.src, x.dst, x.n) for x in got.collect()) == sorted((*k, n) for k, n in want.items())
    plan = got._jdf.queryExecution().optimizedPlan().toString().split("\n")
    last = max(i for i, x in enumerate(plan) if "Generate explode(__a" in x)
    assert not any(word in x for x in plan[:last] for word in ("Join", "Aggregate", "Repartition"))
