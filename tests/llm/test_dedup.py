import hashlib
from collections import defaultdict

import numpy as np
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from axonlake.llm import components, exact_dedup, simhash

from . import data


def test_radix_groups_match_brute_force(spark):
    docs = data.documents(spark)
    for width, growth in ((256, 16), (1, 2 ** 10), (3, 50)):
        got = exact_dedup.msd_radix_groups(docs, first_width=width, growth=growth).collect()
        rows = [(r.doc_id, r.text or "") for r in docs.collect()]
        groups = defaultdict(list)
        for i, t in rows:
            groups[t].append(i)
        want = sorted((str(i), str(max((x for x in groups[t] if x is not None), default=None)), len(groups[t]), hashlib.sha256(t.encode()).hexdigest()) for i, t in rows)
        assert sorted((str(r.doc_id), str(r.keep_id), r.group_size, r.text_sha256) for r in got) == want
        assert sum(r.kept for r in got) == len(groups)  # one row of each set of equal texts, repeated rows included
        assert all(r.kept <= (r.doc_id == r.keep_id) for r in got)


def test_drop_exact_copies(spark):
    docs = data.documents(spark)
    kept = exact_dedup.drop_exact_copies(docs)
    assert kept.columns == docs.columns
    texts = [r.text or "" for r in kept.collect()]
    assert sorted(texts) == sorted({r.text or "" for r in docs.collect()})
    assert exact_dedup.msd_radix_groups(data.empty(spark)).count() == 0
    assert exact_dedup.drop_exact_copies(data.empty(spark)).count() == 0


def plain_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i : i + 4]) for i in range(len(words) - 3)] or ([b" ".join(words)] if words else [])
    hs = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="aB é\n\t\x1c.x", max_size=40))
def test_fingerprint(text):
    assert simhash.simhash_bytes(text.encode()) == plain_fingerprint(text)


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 2**64 - 1), st.lists(st.integers(0, 63), max_size=4))
def test_manhattan_is_a_lower_bound_and_some_grid_is_shared(a, flips):
    b = a
    for f in flips:
        b ^= 1 << f

    def unary(x):
        return ((x | x >> 1) & simhash.EVEN_BITS) | ((x & x >> 1) & simhash.EVEN_BITS) << 1

    apart = unary(a) ^ unary(b)
    assert apart.bit_count() <= (a ^ b).bit_count()
    on = sum(1 << k for k in range(8) if not apart >> 8 * k & 255)
    assert simhash.FIRST_GRID[on] >= 0


def brute_components(fps, distance=4):
    parent = {f: f for f in fps}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    values = sorted(fps)
    arr = np.array([v & (2**64 - 1) for v in values], np.uint64)
    for i, v in enumerate(values):
        for j in np.flatnonzero(np.bitwise_count(arr ^ arr[i]) <= distance):
            a, b = find(v), find(values[j])
            parent[max(a, b)] = min(a, b)
    return {f: find(f) for f in fps}


def test_links_and_components_match_brute_force(spark):
    r = np.random.RandomState(3)
    fps = set()
    for base in r.randint(-(2**63), 2**63 - 1, 30):
        for _ in range(10):
            x = int(base) & (2**64 - 1)
            for _ in range(r.randint(0, 7)):
                x ^= 1 << int(r.randint(0, 64))
            fps.add(x - (1 << 64) if x >> 63 else x)
    df = spark.createDataFrame([(f,) for f in fps], "fp long")
    want = brute_components(fps)
    linked = {f for f in fps if sum(want[g] == want[f] for g in fps) > 1}
    for limit in (256, 4, 2):  # a low limit parts dense cells by their exact bits and sends what stays dense through midpoints
        got = {x.node: x.component for x in components.connected_components(simhash.near_links(df, 4, limit)).collect()}
        assert set(got) == linked and all(got[f] == want[f] for f in linked)
    for distance, limit in ((3, 1), (1, 1)):
        want = brute_components(fps, distance)
        linked = {f for f in fps if sum(want[g] == want[f] for g in fps) > 1}
        got = {x.node: x.component for x in components.connected_components(simhash.near_links(df, distance, limit)).collect()}
        assert set(got) == linked and all(got[f] == want[f] for f in linked)


def test_near_duplicate_classes(spark):
    docs = data.documents(spark)
    got = simhash.near_duplicate_classes(docs).collect()
    assert len(got) == docs.count()
    fp = defaultdict(set)
    for r in docs.collect():
        fp[r.doc_id].add(f"{plain_fingerprint(r.text):016x}")
    assert all(r.fingerprint in fp[r.doc_id] for r in got)
    label = brute_components({int(r.fingerprint, 16) for r in got})
    members = defaultdict(list)
    for r in got:
        members[label[int(r.fingerprint, 16)]].append(r.doc_id)
    for r in got:
        assert r.component_id == min((i for i in members[label[int(r.fingerprint, 16)]] if i is not None), default=None)
    assert simhash.near_duplicate_classes(data.empty(spark)).count() == 0


def test_long_chain_of_edges(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(200)] + [(5, 5), (900, 901), (901, 900)], "a long, b long")
    got = {r.node: r.component for r in components.connected_components(edges).collect()}
    assert all(got[i] == 0 for i in range(201)) and got[901] == 900 and len(got) == 203
