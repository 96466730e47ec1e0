"""Levels, ranks and detours beyond the caps that operators once had."""

import itertools
import math

import numpy as np

from axonlake.operators import graph_extra, kernels, network, signal


def test_rich_club_has_every_level(spark):
    rows = [("a", i, j, float(1 + (i * j) % 7)) for i, j in itertools.combinations(range(70), 2)] + [("a", 0, 70, 9.0), ("b", 0, 1, 2.0)]
    got = {(r.rec, r.k): r.rw for r in network.rich_club(spark.createDataFrame(rows, "rec string, src long, dst long, w double"), ["rec"]).collect()}
    want = {}
    for rec in ("a", "b"):
        e = [(i, j, w) for r, i, j, w in rows if r == rec]
        deg = {n: sum(n in (i, j) for i, j, _ in e) for n in {x for i, j, _ in e for x in (i, j)}}
        strongest = sorted((w for _, _, w in e), reverse=True)
        for k in range(1, max(deg.values()) + 1):
            club = [w for i, j, w in e if min(deg[i], deg[j]) >= k]
            if club:
                want[rec, k] = sum(club) / sum(strongest[: len(club)])
    assert max(k for _, k in want) == 69 and got.keys() == want.keys() and all(abs(got[x] - want[x]) < 1e-9 for x in want)


def test_edge_ranges_go_all_the_way_round(spark):
    rows = [("ring", i, (i + 1) % 12) for i in range(12)] + [("line", 0, 1), ("line", 1, 2)] + [("tri", 0, 1), ("tri", 1, 2), ("tri", 0, 2)]
    df = spark.createDataFrame([(r, i, j, 1.0) for r, i, j in rows], "rec string, src long, dst long, w double")
    got = {(r.rec, r.src, r.dst): r.range for r in graph_extra.edge_ranges(df, ["rec"]).collect()}
    assert got == {x: {"ring": 11, "line": None, "tri": 2}[x[0]] for x in rows}
    assert graph_extra.edge_ranges(df.limit(0), ["rec"]).count() == 0


def test_nmf_sweeps_to_the_channels(spark):
    """Twelve channels with one strong common pattern and a weak one each: only the shuffled counts need a component for every channel at once."""
    rows = [("a", ch, b, 100) for ch in range(12) for b in range(36)] + [("a", ch, 36 + 3 * ch + i, 20) for ch in range(12) for i in range(3)]
    got = kernels.nmf_components(spark.createDataFrame(rows, "rec string, ch long, bin long, n long")).collect()
    assert [r.rec for r in got] == ["a"] and got[0].components > 10


def plain_events(v, fs, widths_ms=(0.4, 0.5, 0.6, 0.7, 0.8)):
    """The decision of detect_by_wavelet over one whole channel."""
    psi, step = signal.biorthogonal_1_5()
    hit = np.zeros(len(v), bool)
    for a in (w * fs / 1000 for w in widths_ms):
        c = signal.wavelet_coefficients(v, a, psi, step)
        sigma = np.median(np.abs(c[:: max(1, round(a))] - c.mean())) / 0.6745
        th = sigma * math.sqrt(2 * math.log(len(v)))
        big = np.abs(c) > th
        m, p = (np.abs(c[big]).mean(), big.mean()) if big.any() else (th, 1 / len(v))
        hit |= c > max(0.0, m / 2 + sigma**2 / m * math.log((1 - p) / p))
    runs = []
    for f in np.flatnonzero(hit):
        if runs and f - runs[-1][1] <= max(1, round(0.0001 * fs)):
            runs[-1][1] = f
        else:
            runs.append([f, f])
    return [int(b + e) // 2 for b, e in runs]


def test_wavelet_events_do_not_depend_on_the_chunk(spark):
    rng = np.random.RandomState(4)
    want, rows = {}, []
    for ch in range(2):
        v = rng.randn(3000) * np.where(np.arange(3000) < 1500, 0.3, 3.0)
        for at in rng.randint(50, 2950, 25):
            v[at : at + 5] += 25 * (ch + 1)
            v[at + 5 : at + 10] -= 25 * (ch + 1)
        want[ch] = plain_events(v, 12500.0)
        rows += [("a", ch, i, float(x)) for i, x in enumerate(v)]
    df = spark.createDataFrame(rows, "rec string, ch long, frame long, v double").cache()
    for frames in (400, 1500, 100_000):
        got = signal.detect_by_wavelet(df, 12500.0, frames=frames).collect()
        assert {ch: sorted(r.frame for r in got if r.ch == ch) for ch in want} == want
    assert all(len(x) > 5 for x in want.values())
