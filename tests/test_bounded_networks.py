"""Searches and counts over whole networks whose shuffles and memory must not grow with the pairs of nodes."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from axonlake.operators import graph_extra as g
from axonlake.operators import kernels, meetings, network

KEY = ["rec"]


def weighted(seed: int, n: int = 40, m: int = 70) -> dict[tuple[int, int], float]:
    r = np.random.RandomState(seed)
    return {(min(a, b), max(a, b)): float(w) for a, b, w in zip(r.randint(0, n, m).tolist(), r.randint(0, n, m).tolist(), r.randint(1, 4, m)) if a != b}


def shortest(edges: dict, n: int = 40) -> np.ndarray:
    d = np.full((n, n), np.inf)
    for (a, b), w in edges.items():
        d[a, b] = d[b, a] = 1 / w
    for k in range(n):
        d = np.minimum(d, d[:, k : k + 1] + d[k])
    np.fill_diagonal(d, np.inf)
    return d


@pytest.fixture(scope="module")
def nets(spark):
    return {rec: weighted(i) for i, rec in enumerate("ab")}


@pytest.fixture(scope="module")
def edges(spark, nets):
    return spark.createDataFrame([(rec, a, b, w) for rec, e in nets.items() for (a, b), w in e.items()], "rec string, src long, dst long, w double")


def test_hops_of_a_component_without_all_its_pairs_in_a_group(spark, monkeypatch):
    n = 3000  # a star: two hops between any two leaves
    arcs = spark.range(1, n).select(F.lit("a").alias("rec"), F.lit(0).cast("long").alias("src"), F.col("id").alias("dst"))
    arcs = arcs.unionByName(arcs.select("rec", F.col("dst").alias("src"), F.col("src").alias("dst")))
    d = kernels.arc_counts(arcs, KEY)
    assert "FlatMapGroupsInArrow" in d._jdf.queryExecution().executedPlan().toString()  # groups come and go in batches
    assert {tuple(r) for r in d.groupBy("d").count().collect()} == {(1, 2 * (n - 1)), (2, (n - 1) * (n - 2))}
    nodes, leaves = np.arange(n), np.arange(1, n)
    monkeypatch.setattr(kernels, "PIECE_DISTANCES", 5 * n)
    order = np.argsort(tails := np.concatenate([leaves * 0, leaves]), kind="stable")
    pieces = [len(p["d"]) for p in kernels._pairs(np.concatenate([leaves, leaves * 0])[order], tails[order], np.ones(2 * n - 2), nodes[:70], nodes)]
    assert max(pieces) <= 5 * n and sum(pieces) == 70 * (n - 1)


def test_distances_and_their_sums_by_levels_and_by_rounds(spark, nets, edges, monkeypatch):
    for lengths in (8, 0):
        monkeypatch.setattr(kernels, "MOST_LENGTHS", lengths)
        for rec, e in nets.items():
            d = shortest(e)
            ends = np.array([(a, b, 1 / w) for (a, b), w in e.items()] + [(b, a, 1 / w) for (a, b), w in e.items()])
            ends = ends[np.argsort(ends[:, 1], kind="stable")]
            nodes, at = np.unique(ends[:, :2].astype(int), return_inverse=True)
            args = at.reshape(-1, 2)[:, 0], at.reshape(-1, 2)[:, 1], ends[:, 2], np.arange(len(nodes)), nodes
            got = {(s, t): x for p in kernels._pairs(*args) for s, t, x in zip(p["src"].tolist(), p["dst"].tolist(), p["d"].tolist())}
            want = {(i, j): d[i, j] for i in range(40) for j in range(40) if np.isfinite(d[i, j])}
            assert got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)
            for p in kernels._sums(*args):
                for s, far, close, reached in zip(*(p[c].tolist() for c in ("src", "far", "close", "reached"))):
                    ok = np.isfinite(d[s])
                    assert reached == ok.sum() and abs(far - d[s][ok].sum()) < 1e-9 and abs(close - (1 / d[s]).sum()) < 1e-9


def test_nodal_efficiency_from_sums(spark, edges):
    nodes = network.degrees(edges, KEY).select("rec", "node")
    sums = network.path_sums(edges, KEY)
    assert sums.count() == nodes.count()
    a, b = ({(r.rec, r.node): round(r.ne, 9) for r in network.nodal_efficiency(p, nodes, KEY).collect()} for p in (sums, network.shortest_paths(edges, KEY)))
    assert a == b


def test_path_metrics_from_sums(spark, nets, edges):
    for r in network.path_metrics(network.path_sums(edges, KEY), network.degrees(edges, KEY), KEY).collect():
        d, n = shortest(nets[r.rec]), len({x for e in nets[r.rec] for x in e})
        assert abs(r.path_length - d[np.isfinite(d)].mean()) < 1e-9 and abs(r.global_efficiency - (1 / d).sum() / (n * n - n)) < 1e-9


def test_components_of_joined_stars(spark):
    rows = [(rec, a, b) for rec in "ab" for a, b in ((5, 3), (3, 9), (9, 5), (2, 8), (7, 7), (11, 12), (12, 1))]
    e = spark.createDataFrame(rows, "rec string, src long, dst long").withColumn("w", F.lit(1.0))
    want = {3: 3, 5: 3, 9: 3, 2: 2, 8: 2, 7: 7, 1: 1, 11: 1, 12: 1}
    for most in (1 << 22, 2):
        stars = network._stars(e, KEY, most)
        got = {(r.rec, r.node): r.component for r in network.components(stars.withColumn("w", F.lit(1.0)), KEY).collect()}
        assert got == {(rec, k): v for rec in "ab" for k, v in want.items()}


@pytest.fixture(scope="module")
def close(spark):
    """Pairs of 24 nodes as a dict, their edges, and plain neighbours."""
    r = np.random.RandomState(5)
    pairs = {(a, b): float(w) for a, b, w in zip(*r.randint(0, 24, (2, 90)).tolist(), r.randint(1, 5, 90)) if a < b}
    near = {x: {v for p in pairs if x in p for v in p if v != x} for x in range(24)}
    return pairs, near, spark.createDataFrame([("r", *p, w) for p, w in pairs.items()], "rec string, src long, dst long, w double")


@pytest.fixture(params=[1 << 22, 30])
def side(request, monkeypatch):
    monkeypatch.setattr(meetings, "SIDE_ARCS", request.param)
    return request.param


def tiled(df) -> bool:
    """Whether no path of two edges is a row: nothing meets in a join but lists and small tables that are broadcast."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return "FlatMapGroupsInArrow" in plan and "Join Inner" not in plan


def test_matching_index_by_tiles(close, side):
    pairs, near, edges = close
    df = network.matching_index(edges, KEY)
    want = {(x, y): 2 * len(near[x] & near[y]) / (len(near[x]) + len(near[y]) - 2 * ((x, y) in pairs)) for x in range(24) for y in range(x + 1, 24) if near[x] & near[y]}
    got = {(r.src, r.dst): r.m for r in df.collect()}
    assert tiled(df) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_topological_overlap_by_tiles(close, side):
    pairs, near, edges = close
    df = network.topological_overlap(edges, KEY)
    a = {(x, y): (x, y) in pairs for x in range(24) for y in range(x + 1, 24)}
    want = {(x, y): (len(near[x] & near[y]) + e) / (min(len(near[x]), len(near[y])) + 1 - e) for (x, y), e in a.items() if e or near[x] & near[y]}
    got = {(r.src, r.dst): r.o for r in df.collect()}
    assert tiled(df) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


def test_neighbour_overlap_by_tiles(close, side):
    pairs, near, edges = close
    turned = edges.select("rec", F.when(F.col("w") > 2, F.col("dst")).otherwise(F.col("src")).alias("src"), F.when(F.col("w") > 2, F.col("src")).otherwise(F.col("dst")).alias("dst"), "w")
    df = network.neighbour_overlap(turned, KEY)
    jaccard = lambda x, y: len(near[x] & near[y]) / max(1, len((near[x] | near[y]) - {x, y}))
    want = {(p if w <= 2 else p[::-1]): jaccard(*p) for p, w in pairs.items()}
    rows = df.collect()
    got = {(r.src, r.dst): r.o for r in rows}
    assert tiled(df) and len(rows) == len(want) and got.keys() == want.keys() and all(abs(got[k] - want[k]) < 1e-12 for k in want)


@pytest.mark.parametrize("weighted", [False, True])
def test_directed_clustering_and_transitivity_by_tiles(spark, side, weighted):
    r = np.random.RandomState(6)
    arcs = {(a, b): float(w) for a, b, w in zip(*r.randint(0, 20, (2, 150)).tolist(), r.randint(1, 5, 150)) if a != b}
    m = np.zeros((20, 20))
    for (a, b), w in arcs.items():
        m[a, b] = np.cbrt(w) if weighted else 1
    s, k = m + m.T, ((m > 0).sum(0) + (m > 0).sum(1))
    cycles, possible = np.diag(s @ s @ s) / 2, k * (k - 1) - 2 * np.diag((m > 0).astype(float) @ (m > 0).astype(float))
    df = spark.createDataFrame([("r", *p, w) for p, w in arcs.items()], "rec string, src long, dst long, w double")
    got = g.directed_clustering(df, KEY, weighted)
    rows = {x.node: (x.cycles, x.possible) for x in got.collect()}
    assert "FlatMapGroupsInArrow" in got._jdf.queryExecution().optimizedPlan().toString()
    assert rows.keys() == {x for p in arcs for x in p} and all(abs(rows[x][0] - cycles[x]) < 1e-9 and rows[x][1] == possible[x] for x in rows)
    assert abs(g.directed_transitivity(df, KEY, weighted).first().transitivity - cycles.sum() / possible.sum()) < 1e-9


def test_products_are_held_in_part(monkeypatch):
    r = np.random.RandomState(7)
    a, b = r.rand(30, 25) < 0.3, r.rand(25, 40) < 0.3
    (i, m), (n, j) = np.nonzero(a), np.nonzero(b)
    many = b.sum(1)
    for paths, cells in ((1 << 21, 1 << 23), (50, 1 << 23), (50, 100), (1, 1)):
        monkeypatch.setattr(meetings, "HELD_PATHS", paths), monkeypatch.setattr(meetings, "HELD_CELLS", cells)
        for x in (None, r.rand(len(m))):
            got, y = np.zeros((30, 40)), None if x is None else r.rand(len(j))
            for first, end, keys, c in meetings._products(np.concatenate([[0], np.cumsum(a.sum(1))]), m, x, j, np.concatenate([[0], np.cumsum(many)]), y, many, 40):
                flat = got[first:end].reshape(-1)
                flat[slice(None) if keys is None else keys] = c
            left, right = a.astype(float), b.astype(float)
            if x is not None:
                left[i, m], right[n, j] = x, y
            assert np.allclose(got, left @ right)


def test_roles_of_nodes_are_read_and_not_found_again(spark, tmp_path):
    from axonlake.plans import catalog_extra
    from axonlake.sources import views

    seen, plain = [], views.supplier_edges
    try:
        views.supplier_edges = lambda *a: seen.append(1) or plain(*a)
        df = catalog_extra.batch_roles(spark, "/root/testdata/sf0.001")
    finally:
        views.supplier_edges = plain
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    assert len(seen) == 1 and "Join" not in plan and df.count() > 0


def test_peaks_of_a_long_trace(spark):
    from axonlake.operators import signal

    n = 400_000  # 8,000 peaks, each higher than those before it
    f = spark.range(n).select(F.lit("r").alias("rec"), F.lit(0).alias("roi"), F.col("id").alias("frame"), F.when(F.col("id") % 50 == 25, F.col("id") / n + 1).otherwise(0.0).alias("denoised"))
    import time

    began = time.time()
    rows = signal.find_peaks(f, 0.05, 0.02).orderBy("peak").collect()
    assert [r.peak for r in rows] == list(range(25, n, 50)) and all(r.start == r.peak - 1 and r.end == r.peak + 1 for r in rows)
    assert time.time() - began < 30


def test_peaks_as_by_plain_walks(spark):
    from axonlake.operators.signal import Runs

    v = np.random.RandomState(3).randint(0, 9, 300).astype(float)
    for block in (7, 1024):
        runs = Runs(v, block)
        for i in range(1, 299):
            for level in (v[i], v[i] - 2.5):
                for same in (False, True):
                    over = v >= level if same else v > level
                    assert runs.before(i, level, same) == max(np.flatnonzero(over[:i]), default=0)
                    assert runs.after(i, level, same) == min(np.flatnonzero(over[i + 1 :]) + i + 1, default=299)
            assert runs.most(i // 2, i + 1) == v[i // 2 : i + 1].max()


def test_ranks_are_those_of_a_sorted_search():
    from axonlake.operators.stimulus import Ranks

    r = np.random.RandomState(4)
    for at in (np.sort(r.rand(500) * 100), np.sort(np.round(r.rand(500) * 100)), np.sort(np.r_[r.rand(300), 1e6 + r.rand(5)]), np.array([3.0]), np.array([]), np.array([2.0, 2.0])):
        y = np.sort(np.r_[r.rand(400) * 120 - 10, at, np.nextafter(at, -9e9), np.nextafter(at, 9e9), 1e9])
        assert (Ranks(at).below(y) == np.searchsorted(at, y)).all()
