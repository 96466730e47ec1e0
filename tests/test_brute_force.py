"""Network and learning operators against their definitions, written out plainly on small random networks."""

import itertools
import math

import numpy as np
import pytest

from axonlake.operators import connectivity, graph_extra, kernels, learning, network, stats

KEY = ["rec"]


def weights(seed, n=8, share=0.5):
    rng = np.random.RandomState(seed)
    w = np.triu((rng.rand(n, n) < share) * rng.randint(1, 9, (n, n)) / 8.0, 1)
    w[np.arange(n - 1), np.arange(1, n)] += 0.25  # connected
    return w + w.T


NETS = {f"r{s}": weights(s) for s in (1, 2, 3)}


@pytest.fixture(scope="module")
def edges(spark):
    rows = [(r, int(i), int(j), float(w[i, j])) for r, w in NETS.items() for i, j in zip(*np.nonzero(np.triu(w)))]
    return spark.createDataFrame(rows, "rec string, src long, dst long, w double").cache()


def by_node(df, column):
    out = {r: {} for r in NETS}
    for x in df.collect():
        out[x.rec][x.node] = x[column]
    return {r: np.array([v[i] for i in sorted(v)], float) for r, v in out.items()}


def all_paths(length, s, t):
    """Every simple path from s to t with its length."""
    found = []

    def walk(path, d):
        if path[-1] == t:
            found.append((d, tuple(path)))
            return
        for v in range(len(length)):
            if v not in path and np.isfinite(length[path[-1], v]):
                walk([*path, v], d + length[path[-1], v])

    walk([s], 0.0)
    least = min(d for d, _ in found)
    return [p for d, p in found if d <= least * (1 + 1e-9) + 1e-12]


def shortest(length):
    d = length.copy()
    np.fill_diagonal(d, 0)
    for k in range(len(d)):
        d = np.minimum(d, d[:, [k]] + d[[k]])
    return d


def inverse(w):
    with np.errstate(divide="ignore"):
        length = 1 / w
    np.fill_diagonal(length, np.inf)
    return length


def test_betweenness(spark, edges):
    nodes, links = by_node(kernels.betweenness(edges, KEY, offset=0.0), "bc"), {(x.rec, x.src, x.dst): x.eb for x in kernels.edge_betweenness(edges, KEY).collect()}
    for r, w in NETS.items():
        n, want, arcs = len(w), np.zeros(len(w)), {}
        for s, t in itertools.permutations(range(n), 2):
            best = all_paths(inverse(w), s, t)
            for p in best:
                for v in p[1:-1]:
                    want[v] += 1 / len(best)
                for a, b in zip(p, p[1:]):
                    arcs[min(a, b), max(a, b)] = arcs.get((min(a, b), max(a, b)), 0) + 1 / len(best)
        assert np.allclose(nodes[r], want / ((n - 1) * (n - 2)))
        assert all(abs(v - arcs.get((a, b), 0)) < 1e-9 for (q, a, b), v in links.items() if q == r)


def modularity(w, label):
    k, m = w.sum(1), w.sum()
    return sum(w[i, j] - k[i] * k[j] / m for i in range(len(w)) for j in range(len(w)) if label[i] == label[j]) / m


def partitions(n):
    """Every partition of n nodes, as labels."""
    def grow(label):
        if len(label) == n:
            yield label
            return
        for c in range(max(label) + 2):
            yield from grow([*label, c])

    return grow([0])


def test_louvain_comes_close_to_the_best_partition(spark, edges):
    found = by_node(kernels.louvain(edges, KEY), "community")
    for r, w in NETS.items():
        best = max(modularity(w, p) for p in partitions(len(w)))
        assert modularity(w, found[r]) >= 0.9 * best
        own = modularity(w, found[r])
        for i, c in itertools.product(range(len(w)), set(found[r])):  # no single node gains by moving
            other = found[r].copy()
            other[i] = c
            assert modularity(w, other) <= own + 1e-6
    two = np.kron(np.eye(2), np.ones((4, 4)) - np.eye(4))
    two[3, 4] = two[4, 3] = 0.1
    label = kernels.louvain_labels(two, 1.0, np.random.RandomState(0))
    assert len(set(label[:4])) == len(set(label[4:])) == 1 and label[0] != label[4]
    assert list(kernels.louvain_labels(np.zeros((3, 3)), 1.0, np.random.RandomState(0))) == [0, 1, 2]


def test_consensus_and_agreement(spark, edges):
    label = by_node(kernels.consensus_communities(edges, KEY, runs=10), "community")
    assert all(modularity(NETS[r], x) >= 0.8 * max(modularity(NETS[r], p) for p in partitions(8)) for r, x in label.items())
    runs = kernels.louvain(kernels.replicated(edges, 7, "run"), ["rec", "run"])
    got = {(x.rec, x.src, x.dst): x.n for x in network.agreement(runs, KEY).collect()}
    each = {}
    for x in runs.collect():
        each.setdefault((x.rec, x.run), {})[x.node] = x.community
    want = {}
    for (r, _), lab in each.items():
        for i, j in itertools.combinations(sorted(lab), 2):
            if lab[i] == lab[j]:
                want[r, i, j] = want.get((r, i, j), 0) + 1
    assert got == want


def test_partition_distance(spark):
    x, y = [0, 0, 1, 1, 2, 2, 2, 0], [0, 1, 1, 1, 0, 2, 2, 0]
    frame = lambda z: spark.createDataFrame([("a", i, c) for i, c in enumerate(z)], "rec string, node long, community int")
    got = network.partition_distance(frame(x), frame(y), KEY).first()
    h = lambda *z: -sum(p * math.log(p) for p in (list(zip(*z)).count(v) / len(x) for v in set(zip(*z))))
    assert abs(got.vi - (2 * h(x, y) - h(x) - h(y)) / math.log(len(x))) < 1e-9
    assert abs(got.mi - 2 * (h(x) + h(y) - h(x, y)) / (h(x) + h(y))) < 1e-9


def test_spectral_measures(spark, edges):
    comm, rank, eig = by_node(kernels.communicability(edges, KEY), "communicability"), by_node(network.pagerank(edges, KEY), "rank"), by_node(kernels.eigenvector_centrality(edges, KEY), "ec")
    control = kernels.controllability(edges, KEY).cache()
    average, modal = by_node(control, "average"), by_node(control, "modal")
    for r, w in NETS.items():
        n = len(w)
        g, term = np.eye(n), np.eye(n)
        for k in range(1, 80):
            term = term @ w / k
            g = g + term
        assert np.allclose(comm[r], ((g - g.min()) / (g.max() - g.min())).sum(1))
        p = w / w.sum(0)
        assert np.allclose(rank[r], np.linalg.solve(np.eye(n) - 0.85 * p, np.full(n, 0.15 / n)), atol=1e-7)
        v = np.ones(n)
        for _ in range(3000):
            v = w @ v + v
            v /= np.linalg.norm(v)
        assert np.allclose(eig[r], v, atol=1e-6)
        a = w / (1 + np.linalg.norm(w, 2))
        power, gram = np.eye(n), np.zeros((n, n))
        for _ in range(3000):  # infinite-horizon Gramian of each node as the only input: trace of the sum of a^k e e' a'^k
            gram += power**2
            power = a @ power
        assert np.allclose(average[r], gram.sum(axis=0), rtol=1e-6)
        val, vec = np.linalg.eigh(a)
        assert np.allclose(modal[r], [sum((1 - val[j] ** 2) * vec[i, j] ** 2 for j in range(n)) for i in range(n)])


def peel(w, keep):
    w = w.copy()
    while (low := [i for i in range(len(w)) if w[i].any() and not keep(w[i])]):
        w[low] = 0
        w[:, low] = 0
    return w


def test_cores(spark, edges):
    k3 = {(x.rec, x.src, x.dst) for x in network.k_core(edges, KEY, 3).collect()}
    s2 = {(x.rec, x.src, x.dst) for x in network.s_core(edges, KEY, 2.0).collect()}
    core = by_node(network.coreness(edges, KEY), "coreness")
    pairs = lambda r, w: {(r, i, j) for i, j in zip(*np.nonzero(np.triu(w)))}
    assert k3 == set().union(*(pairs(r, peel(w, lambda x: (x > 0).sum() >= 3)) for r, w in NETS.items())) and k3
    assert s2 == set().union(*(pairs(r, peel(w, lambda x: x.sum() >= 2.0)) for r, w in NETS.items())) and s2
    for r, w in NETS.items():
        assert core[r].tolist() == [max(k for k in range(1, 8) if peel(w, lambda x, k=k: (x > 0).sum() >= k)[i].any()) for i in range(len(w))]


def test_local_and_nodal_efficiency(spark, edges):
    local = by_node(network.local_efficiency(edges, KEY), "eloc")
    nodal = by_node(network.nodal_efficiency(network.shortest_paths(edges, KEY), network.degrees(edges, KEY).select("rec", "node"), KEY), "ne")
    for r, w in NETS.items():
        n, x, want = len(w), w / w.max(), []
        for u in range(n):
            near = np.flatnonzero(x[u])
            k = len(near)
            d = shortest(inverse(np.cbrt(x[np.ix_(near, near)])))
            num = sum(np.cbrt(x[u, near[a]]) * np.cbrt(x[u, near[b]]) / d[a, b] for a, b in itertools.permutations(range(k), 2) if np.isfinite(d[a, b]))
            want.append(num / (k * k - k) if k > 1 else 0.0)
        assert np.allclose(local[r], want)
        assert np.allclose(nodal[r], n / shortest(inverse(w)).sum(1))


def test_binary_efficiency_and_backbone(spark, edges):
    got = {x.rec: x.efficiency for x in graph_extra.binary_efficiency(edges, network.degrees(edges, KEY), KEY).collect()}
    tree = {}
    for x in graph_extra.backbone(edges, KEY).collect():
        tree.setdefault(x.rec, []).append((x.src, x.dst, x.w))
    for r, w in NETS.items():
        d = shortest(inverse((w > 0).astype(float)))
        np.fill_diagonal(d, np.inf)
        assert abs(got[r] - (1 / d).sum() / (8 * 7)) < 1e-9
        part, total = list(range(8)), 0.0
        for x, i, j in sorted(((w[i, j], i, j) for i, j in itertools.combinations(range(8), 2) if w[i, j]), reverse=True):
            if part[i] != part[j]:
                total += x
                part = [part[i] if p == part[j] else p for p in part]
        assert len(tree[r]) == 7 and abs(sum(x for _, _, x in tree[r]) - total) < 1e-9


def test_signed_measures(spark):
    rng = np.random.RandomState(9)
    w = np.triu(rng.randint(-4, 5, (9, 9)), 1).astype(float)
    df = spark.createDataFrame([("a", int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(w))], "rec string, src long, dst long, w double")
    label = spark.createDataFrame([("a", i, i % 3) for i in range(9)], "rec string, node long, community int")
    w = w + w.T
    got = {x.node: x for x in graph_extra.signed_clustering(df, KEY).collect()}
    share = {x.node: x for x in graph_extra.signed_participation(df, label, KEY).collect()}
    for sign, name in ((1, "positive"), (-1, "negative")):
        p = np.maximum(sign * w, 0)
        c, k = np.cbrt(p), (p > 0).sum(1)
        cc = np.divide((c @ c @ c).diagonal(), k * (k - 1), out=np.zeros(9), where=k > 1)
        assert np.allclose([got[i][name] for i in sorted(got)], cc[sorted(got)])
        for i in share:
            s = p[i].sum()
            want = 1 - sum((p[i, j::3].sum() / s) ** 2 for j in range(3)) if s else None
            assert share[i][name] == want if want is None else abs(share[i][name] - want) < 1e-9


def test_motifs(spark):
    rng = np.random.RandomState(3)
    a = (rng.rand(9, 9) < 0.3) & ~np.eye(9, dtype=bool)
    df = spark.createDataFrame([("a", int(i), int(j)) for i, j in zip(*np.nonzero(a))], "rec string, src long, dst long")
    got = {x.motif: x.n for x in network.motifs3(df, KEY).collect()}
    want = {}
    for three in itertools.combinations(range(9), 3):
        sub = a[np.ix_(three, three)]
        if (sub | sub.T).sum() >= 4:  # connected
            code = min(int("".join(str(int(a[x, y])) for x, y in ((p, q), (q, p), (p, s), (s, p), (q, s), (s, q))), 2) for p, q, s in itertools.permutations(three))
            want[code] = want.get(code, 0) + 1
    assert got == want


def test_null_networks_keep_what_they_should(spark, edges):
    for kind in ("swap", "lattice", "strength"):
        for x in {r: [y for y in kernels.null_networks(edges, KEY, 2, kind).collect() if y.rec == r] for r in NETS}.items():
            r, rows = x
            for rep in {y.rep for y in rows}:
                w = np.zeros((8, 8))
                for y in rows:
                    if y.rep == rep:
                        w[y.src, y.dst] = w[y.dst, y.src] = y.w
                assert ((w > 0).sum(1) == (NETS[r] > 0).sum(1)).all() and np.allclose(np.sort(w[np.triu(w) > 0]), np.sort(NETS[r][np.triu(NETS[r]) > 0]))


def test_surrogate_weights_match_the_relational_form(spark):
    rng = np.random.RandomState(6)
    rows = [("a", ch, float(t)) for ch in range(5) for t in set(rng.randint(0, 1000, 40))] + [("b", 1, 3.0), ("b", 2, 4.0), ("b", 3, 999.0)]
    spikes = spark.createDataFrame(rows, "rec string, ch long, t double")
    recs = spark.createDataFrame([("a", 1, 1000.0), ("b", 2, 1000.0)], "rec string, rec_no long, duration_s double")
    for dt in (5.0, 30.0):
        want = connectivity.sttc(connectivity.surrogate_trains(spikes, recs, 23, 1.0, 4), recs, dt, ["rec", "rep"]).collect()
        got = connectivity.surrogate_weights(spikes, recs, dt, 23, 1.0, 4).collect()
        as_dict = lambda rows_: {(x.rec, x.rep, x.src, x.dst): round(x.w, 9) for x in rows_}
        assert as_dict(got) == as_dict(want) and len(got) > 20
    assert connectivity.significant_edges(spikes.limit(0), recs, 5.0, 3, fs=1.0).count() == 0


def test_effective_rank(spark):
    rng = np.random.RandomState(2)
    x = rng.randn(60, 5) @ rng.randn(5, 5)
    df = spark.createDataFrame([("a", i, j, float(x[i, j])) for i in range(60) for j in range(5)], "rec string, frame long, roi long, f double")
    lam = np.linalg.eigvalsh(np.cov(x.T))
    p = lam / lam.sum()
    assert abs(kernels.effective_rank(df).first()["rank"] - math.exp(-(p * np.log(p)).sum())) < 1e-6


def test_mixed_model(spark):
    rng = np.random.RandomState(5)
    rows = [("m", s, a, float(2 + 0.7 * a + u + 0.3 * rng.randn())) for s, u in enumerate(rng.randn(12)) for a in range(1, 2 + s % 5)]
    got = stats.mixed_model(spark.createDataFrame(rows, "metric string, subject long, age int, value double"), ["metric"]).first()
    subject, x, y = np.array([r[1] for r in rows]), np.array([[1.0, r[2]] for r in rows]), np.array([r[3] for r in rows])

    def fit(ratio):  # restricted likelihood with the full covariance matrix
        v = np.eye(len(y)) + ratio * (subject[:, None] == subject[None])
        vi = np.linalg.inv(v)
        beta = np.linalg.solve(x.T @ vi @ x, x.T @ vi @ y)
        e = y - x @ beta
        return np.linalg.slogdet(v)[1] + np.linalg.slogdet(x.T @ vi @ x)[1] + (len(y) - 2) * math.log(e @ vi @ e), beta

    best = min(np.exp(np.linspace(-6, 6, 1201)), key=lambda q: fit(q)[0])
    assert abs(math.log(got.ratio / best)) < 0.1
    assert np.allclose([got.intercept, got.slope], fit(best)[1], atol=0.02)


def test_discriminant_and_importance(spark):
    rng = np.random.RandomState(8)
    rows = [(i % 3, *(float(v) for v in rng.randn(4) + (i % 3) * np.array([3, 0, 0, 0.5]))) for i in range(240)]
    wide = spark.createDataFrame(rows, "label int, x0 double, x1 double, x2 double, x3 double")
    names = ["x0", "x1", "x2", "x3"]
    got = {r.label: r for r in stats.discriminant(wide, "label", names).collect()}
    x, y = np.array([r[1:] for r in rows]), np.array([r[0] for r in rows])
    z = (x - x.mean(0)) / x.std(0)
    sw = sum((z[y == c] - z[y == c].mean(0)).T @ (z[y == c] - z[y == c].mean(0)) for c in range(3))
    sb = sum((y == c).sum() * np.outer(z[y == c].mean(0), z[y == c].mean(0)) for c in range(3))
    val, vec = np.linalg.eig(np.linalg.solve(sw, sb))
    axis = vec[:, val.real.argmax()].real
    first = np.array([z[y == c].mean(0) @ axis for c in range(3)])
    mine = np.array([got[c].axis_1 for c in range(3)])
    assert abs(abs(np.corrcoef(first, mine)[0, 1]) - 1) < 1e-6 and [got[c].n for c in range(3)] == [80, 80, 80]
    rise = {r.feature: r.importance for r in learning.permutation_importance(wide, "label", names, bucket_rows=50).collect()}
    assert set(rise) == set(names) and rise["x0"] > 0.2 and rise["x0"] == max(rise.values())
