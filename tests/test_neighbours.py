"""Nearest neighbours against brute force."""

import numpy as np
import pytest

from axonlake.operators import neighbours


def table(spark, n=240, dims=3, seed=2):
    r = np.random.RandomState(seed)
    x = np.concatenate([r.normal(0, 1, (n // 2, dims)), r.normal(6, 0.5, (n // 4, dims)), np.ones((n // 4, dims))])  # a group of copies
    ids = r.permutation(10 * n)[: len(x)]
    rows = [(int(i), int(i) % 2, int(v[0] > 3), *map(float, v)) for i, v in zip(ids, x)]
    names = [f"x{j}" for j in range(dims)]
    df = spark.createDataFrame([*rows, (-1, 0, 0, None, 1.0, 1.0), (None, 0, 0, 1.0, 1.0, 1.0)], "id long, fold int, y int, " + ", ".join(f"{c} double" for c in names))
    return df, rows, names


def brute(rows, k, by_fold):
    out = set()
    for a in rows:
        found = sorted((sum((p - q) ** 2 for p, q in zip(a[3:], b[3:])), b[0]) for b in rows if (b[1] != a[1] if by_fold else b[0] != a[0]))
        out |= {(a[0], rank, b, round(d**0.5, 9)) for rank, (d, b) in enumerate(found[:k], 1)}
    return out


@pytest.mark.parametrize("k, by_fold, pivots, chunk", [(1, True, 8, 10), (3, False, 5, 7), (4, True, 1, 1000), (2, False, 500, 3)])
def test_neighbours_equal_brute_force(spark, k, by_fold, pivots, chunk):
    df, rows, names = table(spark)
    got = neighbours.nearest_neighbours(df, names, k, fold_col="fold" if by_fold else None, pivots=pivots, chunk=chunk)
    assert {(r.id, r["rank"], r.neighbour, round(r.distance, 9)) for r in got.collect()} == brute(rows, k, by_fold)


def test_far_chunks_are_not_compared(spark):
    df, rows, names = table(spark)
    plan = neighbours.nearest_neighbours(df, names, 1, pivots=8, chunk=10)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Cross" not in plan


def test_few_rows_and_votes(spark):
    df, rows, names = table(spark)
    assert neighbours.nearest_neighbours(df.limit(0), names, 2).count() == 0
    two = df.filter(f"id in ({rows[0][0]}, {rows[1][0]})")
    assert {(r.id, r["rank"], r.neighbour) for r in neighbours.nearest_neighbours(two, names, 5).collect()} == {(rows[0][0], 1, rows[1][0]), (rows[1][0], 1, rows[0][0])}
    p = neighbours.knn_predictions(df, "y", names, 3, chunk=20).collect()
    assert len(p) == len(rows) and np.mean([r.y != r.predicted for r in p]) < 0.02


@pytest.mark.parametrize("k, by_fold, tile", [(3, True, 37), (2, False, 90)])
def test_rows_are_sent_once_for_each_tile(spark, k, by_fold, tile):
    """Small chunks in few tiles: neighbours by brute force, and no list of a chunk's rows is joined to another one."""
    df, rows, names = table(spark)
    got = neighbours.nearest_neighbours(df, names, k, fold_col="fold" if by_fold else None, pivots=6, chunk=9, tile=tile)
    assert {(r.id, r["rank"], r.neighbour, round(r.distance, 9)) for r in got.collect()} == brute(rows, k, by_fold)
    assert "members" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_blocks_meet_as_all_pairs_do():
    r = np.random.RandomState(4)
    x = np.concatenate([r.normal(1e3, 1, (40, 5)), np.full((300, 5), 1e3)])
    ids, fold = r.permutation(1000)[: len(x)], r.randint(0, 2, len(x))
    for folds in (True, False):
        for within in (np.inf, 2.5):
            i, names, square = neighbours._meet(ids, fold, x, np.full(len(x), within), ids, fold, x, 3, folds)
            got = sorted(zip(i.tolist(), square.tolist(), names.tolist()))
            want = []
            for a in range(len(x)):
                near = sorted((float(((x[b] - x[a]) ** 2).sum()), int(ids[b])) for b in range(len(x)) if (fold[b] != fold[a] if folds else a != b))
                want += [(a, *v) for v in near if v[0] <= within][:3]
            assert [v for v in got if v[1] <= within] == want
