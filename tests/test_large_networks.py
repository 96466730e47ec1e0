"""Relational loops on networks far beyond an instrument's size, against plain versions."""

import heapq

import numpy as np
import pytest

from axonlake.operators import network

KEY = ["rec"]
N = 1500


@pytest.fixture(scope="module")
def large(spark):
    r = np.random.RandomState(11)
    hubs = r.zipf(1.7, (4000, 2)) * 7 % N  # a few nodes have very many edges
    pairs = {(int(min(a, b)), int(max(a, b))) for a, b in [*hubs, *r.randint(0, N, (2500, 2)), *((i, i + 1) for i in range(N, N + 60))] if a != b}  # and a chain of its own
    rows = [("big", a, b, float(r.randint(1, 9)) / 8) for a, b in sorted(pairs)]
    adjacent: dict[int, dict[int, float]] = {}
    for _, a, b, w in rows:
        adjacent.setdefault(a, {})[b] = w
        adjacent.setdefault(b, {})[a] = w
    return spark.createDataFrame(rows, "rec string, src long, dst long, w double"), adjacent


def test_components(large):
    edges, adjacent = large
    label = {}
    for start in sorted(adjacent):
        stack = [start] if start not in label else []
        while stack:
            x = stack.pop()
            if x not in label:
                label[x] = start
                stack.extend(adjacent[x])
    assert {x.node: x.component for x in network.components(edges, KEY).collect()} == label
    assert len(set(label.values())) > 1 and max(adjacent) == N + 60


def test_coreness(large):
    edges, adjacent = large
    degree = {v: len(a) for v, a in adjacent.items()}
    queue, core, k = [(d, v) for v, d in degree.items()], {}, 0
    heapq.heapify(queue)
    while queue:
        d, v = heapq.heappop(queue)
        if v in core or d != degree[v]:
            continue
        k = max(k, d)
        core[v] = k
        for u in adjacent[v]:
            if u not in core:
                degree[u] -= 1
                heapq.heappush(queue, (degree[u], u))
    got = network.coreness(edges, KEY)
    column = next(c for c in got.columns if c not in ("rec", "node"))
    assert {x.node: x[column] for x in got.collect()} == core


def test_pagerank(large):
    edges, adjacent = large
    nodes = sorted(adjacent)
    at = {v: i for i, v in enumerate(nodes)}
    w = np.zeros((len(nodes),) * 2)
    for v, a in adjacent.items():
        for u, x in a.items():
            w[at[v], at[u]] = x
    share, rank = w / w.sum(axis=1, keepdims=True), np.full(len(nodes), 1 / len(nodes))
    for _ in range(300):
        rank = 0.15 / len(nodes) + 0.85 * rank @ share
    got = network.pagerank(edges, KEY)
    column = next(c for c in got.columns if c not in ("rec", "node"))
    found = {x.node: x[column] for x in got.collect()}
    total = sum(found.values())
    assert all(found[v] / total == pytest.approx(rank[at[v]] / rank.sum(), rel=1e-5) for v in nodes)
