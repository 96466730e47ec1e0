import hashlib
import random
import re
import zlib

import pytest

from axonlake.llm import prefix_trie
from axonlake.llm.prefix_trie import WIDTH, Node, RadixTree

SCHEMA = "conv_id long, turn long, role string, text string, digest string, key string, path string, depth int, n int, code string"


def conversations(spark, n=160, seed=3):
    """Few distinct turns, so that prefixes are shared; nulls, ties, repeated rows, a long conversation and columns of clashing names."""
    r = random.Random(seed)
    rows = []
    for c in sorted(r.sample(range(-40, 400), n)):
        for t in range(r.choice([1, 1, 2, 3, 4, 6])):
            rows.append((c, None if r.random() < 0.05 else t, r.choice(["user", "system", None]), r.choice(["a b", "a  b\tc", "", None, "x", "y z"])))
    rows += [(500, 1, "user", "tie"), (500, 1, "user", "other"), (500, 1, "user", "tie"), (None, 0, "user", "nobody's"), (None, None, None, None)]
    rows += [(620, t, "user", f"turn {t}") for t in range(300)] + [(621, t, "user", f"turn {t}") for t in range(300)] + [(640, t, "u", "same") for t in range(50)]
    rows += [(c, 0, "user", "the same first turn") for c in range(1000, 1100)]
    r.shuffle(rows)
    return spark.createDataFrame([(*x, "d", "k", "p", 1, 2, "c") for x in rows], SCHEMA), rows


def brute_trie(rows):
    code = lambda role, text: hashlib.sha256(f"{len((role or '').encode())}:{role or ''}{text or ''}".encode()).hexdigest()
    own = {}
    for c, turn, role, text in rows:
        if c is not None:
            own.setdefault(c, []).append(((turn is not None, turn or 0), code(role, text), (role or "", text or "")))
    own = {c: [x[2] for x in sorted(turns)] for c, turns in own.items()}
    members = {}
    for c, turns in own.items():
        h = zlib.crc32(str(c).encode()) % 4
        base = c - (abs(c) % 20) * (1 if c >= 0 else -1)
        whole = tuple(own.get(base, [])[:h] + turns[h:])
        for d in range(len(whole) + 1):
            members.setdefault(whole[:d], []).append((c, d == len(whole)))
    words = lambda p: len(re.findall(r"[^\x20\x09-\x0D]+", p[-1][1])) if p else 0
    children = {}
    for p in members:
        if p:
            children.setdefault(p[:-1], []).append(p)
    leaves, saved, out = {}, {}, set()
    for p in sorted(members, key=len, reverse=True):
        leaves[p] = sum(leaves[q] for q in children[p]) if p in children else 1
        saved[p] = (len(members[p]) - 1) * words(p) + sum(saved[q] for q in children.get(p, ()))
    low = {p: min(c for c, _ in m) for p, m in members.items()}
    for p, m in members.items():
        ends = ",".join(str(c) for c in sorted(c for c, end in m if end))
        out.add((low[p], len(p), low[p[:-1]] if p else None, len(m), len(children.get(p, ())), leaves[p], saved[p], hashlib.sha256(ends.encode()).hexdigest()))
    return out


COLUMNS = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


@pytest.mark.parametrize("run_keys", [1, 2, 7, 20_000])
def test_nodes_against_brute_force_for_any_run_size(spark, monkeypatch, run_keys):
    monkeypatch.setattr(prefix_trie, "CHUNK_BITS", 3)  # ids of one node come in several pieces
    df, rows = conversations(spark)
    got = prefix_trie.conversation_trie(df, run_keys=run_keys)
    assert got.columns == COLUMNS
    found = [tuple(r) for r in got.collect()]
    assert len(found) == len(set(found)) and set(found) == brute_trie(rows)


def test_one_and_no_conversation(spark):
    one = spark.createDataFrame([(7, 0, "user", "hello you")], "conv_id long, turn long, role string, text string")
    assert {tuple(r) for r in prefix_trie.conversation_trie(one).collect()} == brute_trie([(7, 0, "user", "hello you")])
    assert prefix_trie.conversation_trie(one.limit(0)).count() == 0
    assert prefix_trie.conversation_trie(one.withColumn("conv_id", one.conv_id * None)).count() == 0


def test_layouts_grow_and_keep_order():
    node, r = Node(b""), random.Random(1)
    edges = r.sample(range(256), 256)
    layouts = []
    for k, e in enumerate(edges):
        node.put(e, Node(bytes([e])))
        layouts.append(node.layout)
        assert [c.path[0] for c in node.ordered()] == sorted(edges[: k + 1])
        assert node.find(e).path == bytes([e]) and (k == 255 or node.find(edges[k + 1]) is None)
    assert [layouts[k] for k in (3, 4, 15, 16, 47, 48, 255)] == [4, 16, 16, 48, 48, 256, 256]
    other = Node(b"other")
    node.put(edges[0], other)
    assert node.find(edges[0]) is other


def test_tree_holds_its_keys_with_compressed_paths():
    r = random.Random(2)
    keys = sorted({bytes(r.choice(b"ab") for _ in range(r.randrange(0, 5))) + b"long tail" * r.randrange(2) for _ in range(300)})
    tree = RadixTree()
    for i in r.sample(range(len(keys)), len(keys)):
        tree.insert(keys[i], i)
    for i, k in enumerate(keys):
        path = list(tree.along(k))
        assert path[-1].value == i
    stack, nodes = [tree.root], 0
    while stack:
        node = stack.pop()
        nodes += 1
        kids = node.ordered()
        assert node is tree.root or node.value >= 0 or len(kids) > 1  # no chain of single children
        stack.extend(kids)
    assert nodes <= 2 * len(keys) + 1 and WIDTH == 20
