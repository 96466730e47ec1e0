"""Null networks: what each kind keeps, what it changes, and the ratios built on them."""

import numpy as np
import pytest

from axonlake.operators import kernels

KEY = ["rec"]


def signed(seed, n=14, share=0.5):
    r = np.random.RandomState(seed)
    w = np.triu((r.rand(n, n) < share) * r.choice([-1, 1], (n, n), p=[0.4, 0.6]) * r.randint(1, 200, (n, n)) / 64.0, 1)
    return w + w.T


def multiset(w, sign):
    return sorted((sign * w)[np.triu(sign * w > 0)].tolist())


def clustering(w):
    k, s = (w > 0).sum(1), np.cbrt(w / w.max())
    return np.mean(np.where(k > 1, np.diag(s @ s @ s) / np.maximum(k * (k - 1), 1), 0))


@pytest.mark.parametrize("seed", range(6))
def test_signed_swaps_keep_signs_of_every_node_and_all_weights(seed):
    w = signed(seed)
    out = kernels.swap_signed(w, np.random.RandomState(seed + 50))
    again = kernels.reassign_weights(out, w, np.random.RandomState(9))
    for x in (out, again):
        assert (x == x.T).all() and not np.diag(x).any()
        for sign in (1, -1):
            assert ((sign * x > 0).sum(1) == (sign * w > 0).sum(1)).all() and multiset(x, sign) == multiset(w, sign)
    assert (np.sign(out) != np.sign(w)).mean() > 0.2 and ((out != 0) == (again != 0)).all()


def test_reassigned_weights_keep_strengths_of_each_sign_better_than_swaps():
    apart = {"swap": 0.0, "strength": 0.0}
    for seed in range(12):
        w = signed(seed, 24)
        out = kernels.swap_signed(w, np.random.RandomState(seed))
        for name, x in (("swap", out), ("strength", kernels.reassign_weights(out, w, np.random.RandomState(seed)))):
            apart[name] += sum(np.abs(np.maximum(s * x, 0).sum(1) - np.maximum(s * w, 0).sum(1)).sum() for s in (1, -1))
    assert apart["strength"] < 0.7 * apart["swap"]


def test_networks_without_a_swap_stay():
    full = np.ones((6, 6)) - np.eye(6)
    for w in (full, -full, np.zeros((5, 5)), signed(1, 3), np.zeros((0, 0))):
        assert (kernels.swap_signed(w, np.random.RandomState(1)) == w).all()
    for w in (full, np.zeros((5, 5))):
        assert (kernels.swap_edges(w, np.random.RandomState(1), 200) == w).all()


def ring(n=24, seed=3):
    """A ring lattice with a fifth of its edges moved at random."""
    r, w = np.random.RandomState(seed), np.zeros((n, n))
    for i in range(n):
        for k in (1, 2, 3):
            j = (i + k) % n if r.rand() > 0.2 else r.choice([x for x in range(n) if x != i and not w[i, x]])
            w[i, j] = w[j, i] = r.randint(1, 64) / 64
    return w


@pytest.mark.parametrize("seed", range(4))
def test_lattice_swaps_never_add_to_the_distance(seed):
    w = ring(seed=seed)
    d, before = kernels.profile_distance(w), None
    assert np.allclose(d, [[np.linalg.norm(a - b) for b in w] for a in w], atol=1e-6)
    for swaps in (0, 20, 200, 2000):
        out = kernels.swap_edges(w, np.random.RandomState(seed), swaps, d)
        total = (out * d).sum()
        assert ((out > 0).sum(1) == (w > 0).sum(1)).all() and multiset(out, 1) == multiset(w, 1)
        assert before is None or total <= before + 1e-9
        before = total
    random = np.mean([clustering(kernels.swap_edges(w, np.random.RandomState(k), 2000)) for k in range(5)])
    assert clustering(out) > random


def test_small_world_ratios_against_plain_metrics(spark):
    nets = {f"r{k}": ring(seed=k) for k in (1, 2)}
    rows = [(r, int(i), int(j), float(w[i, j])) for r, w in nets.items() for i, j in zip(*np.nonzero(np.triu(w)))]
    edges = spark.createDataFrame(rows, "rec string, src long, dst long, w double")

    def path_length(w):
        d = np.where(w > 0, 1 / np.where(w > 0, w, 1), np.inf)
        np.fill_diagonal(d, 0)
        for k in range(len(d)):
            d = np.minimum(d, d[:, [k]] + d[[k]])
        return d[np.isfinite(d) & (d > 0)].mean()

    null = {}
    for kind in ("swap", "lattice"):
        for x in kernels.null_networks(edges, KEY, 1, kind, 7).collect():
            w = null.setdefault((x.rec, kind), np.zeros((24, 24)))
            w[x.src, x.dst] = w[x.dst, x.src] = x.w
    got = {x.rec: x for x in kernels.small_worldness(edges, KEY, 7).collect()}
    assert set(got) == set(nets)
    for r, w in nets.items():
        c, cr, cl = clustering(w), clustering(null[r, "swap"]), clustering(null[r, "lattice"])
        p, pr = path_length(w), path_length(null[r, "swap"])
        assert got[r].sigma == pytest.approx((c / cr) / (p / pr), rel=1e-6) and got[r].sigma > 1
        assert got[r].omega == pytest.approx(pr / p - c / cl, rel=1e-6) and -1 <= got[r].omega <= 1
        assert got[r].cc_norm == pytest.approx(c / cl, rel=1e-6) and got[r].pl_norm == pytest.approx(p / pr, rel=1e-6)


def test_normalised_participation_against_its_definition(spark):
    w = np.maximum(signed(5, 16), 0)
    rows = [("a", int(i), int(j), float(w[i, j])) for i, j in zip(*np.nonzero(np.triu(w)))]
    edges = spark.createDataFrame(rows, "rec string, src long, dst long, w double")
    communities = spark.createDataFrame([("a", i, i % 3) for i in range(16)], "rec string, node long, community int")
    reps = 6
    nulls = np.zeros((reps, 16, 16))
    for x in kernels.null_networks(edges, KEY, reps, "strength", 3).collect():
        nulls[x.rep - 1, x.src, x.dst] = nulls[x.rep - 1, x.dst, x.src] = x.w
    share = lambda m: np.stack([m[:, [j for j in range(16) if j % 3 == c]].sum(1) for c in range(3)], 1) / w.sum(1, keepdims=True)
    with np.errstate(invalid="ignore"):
        want = 1 - np.median([np.sqrt(0.5 * ((share(w) - share(x)) ** 2).sum(1)) for x in nulls], axis=0)
    got = {x.node: x.pc_norm for x in kernels.normalised_participation(edges, communities, KEY, reps, 3).collect()}
    assert all(got[i] == pytest.approx(want[i], rel=1e-9) for i in range(16) if w[i].any()) and len(got) == int(w.any(1).sum())
