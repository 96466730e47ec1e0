"""Prefix trie of conversations by adaptive radix trees over fixed-width turn ids.

A turn (role, text) becomes WIDTH bytes: the first 16 of its SHA-256, big-endian, and the number of words of its text. A rebuilt conversation
is the run of its turns' ids. Equal conversations become one sequence with a count, so that groups of copies cost one row, and the
distinct sequences are range-partitioned and sorted by their bytes. A task cuts its sorted rows into runs of bounded size and builds one
adaptive radix tree (nodes of 4, 16, 48 and 256 children, compressed paths) for each; only byte depths that are multiples of WIDTH emit nodes.

Sorted runs hold whole subtrees, all but the prefixes of their first and last sequence. A node beside those two spines is final where it is
emitted. Spine nodes are emitted as parts (what hangs from them beside the spines) and merged by the SHA-256 of their prefix. Sums over
subtrees of spine nodes: every spine node belongs to one of the paths through it; a path's suffix sums of what belongs to it, added up over
all paths through a node, give the sum over the node's subtree. There are two paths in each run, so these tables are small.

No prefix owns a task: a first turn that a third of all conversations share is spread over as many ranges as its sequences fill. The SHA-256
of the ids that end at a node is sequential by its definition; the ids are put in order and joined in pieces of CHUNK ids by a
groupBy, and one task streams the pieces of a sequence.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_left, insort

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_staged, only_result, read_table, stage_table

DIGEST, WIDTH = 16, 20
CHUNK_BITS = 12
RUN_KEYS, RUN_BYTES = 20_000, 16 << 20
EMPTY_SHA = hashlib.sha256(b"").hexdigest()


class Node:
    """A radix node: the compressed path after its edge byte, what ends here, and children in a layout that grows with their number.

    Layouts: up to 4 and up to 16 children as sorted edge bytes beside a list, up to 48 through an index of 256 slots, more as 256 places.
    """

    __slots__ = ("path", "value", "layout", "edges", "children", "spine")

    def __init__(self, path: bytes, value: int = -1):
        self.path, self.value, self.layout, self.edges, self.children, self.spine = path, value, 4, bytearray(), [], 0

    def find(self, edge: int) -> Node | None:
        if self.layout <= 16:
            at = bisect_left(self.edges, edge)
            return self.children[at] if at < len(self.edges) and self.edges[at] == edge else None
        if self.layout == 48:
            return self.children[self.edges[edge] - 1] if self.edges[edge] else None
        return self.children[edge]

    def put(self, edge: int, child: Node) -> None:
        """Add a child or replace the one at this edge."""
        if self.layout <= 16:
            at = bisect_left(self.edges, edge)
            if at < len(self.edges) and self.edges[at] == edge:
                self.children[at] = child
                return
            if len(self.edges) < self.layout:
                insort(self.edges, edge)
                self.children.insert(at, child)
                return
            self._grow()
            self.put(edge, child)
        elif self.layout == 48:
            if self.edges[edge]:
                self.children[self.edges[edge] - 1] = child
            elif len(self.children) < 48:
                self.children.append(child)
                self.edges[edge] = len(self.children)
            else:
                self._grow()
                self.put(edge, child)
        else:
            self.children[edge] = child

    def _grow(self) -> None:
        if self.layout == 4:
            self.layout = 16
        elif self.layout == 16:
            index = bytearray(256)
            for slot, edge in enumerate(self.edges):
                index[edge] = slot + 1
            self.layout, self.edges = 48, index
        else:
            places: list = [None] * 256
            for edge, slot in enumerate(self.edges):
                if slot:
                    places[edge] = self.children[slot - 1]
            self.layout, self.edges, self.children = 256, bytearray(), places

    def ordered(self) -> list[Node]:
        """Children by ascending edge byte."""
        if self.layout <= 16:
            return self.children
        if self.layout == 48:
            return [self.children[slot - 1] for slot in self.edges if slot]
        return [c for c in self.children if c is not None]


def _agree(a: bytes, b: bytes) -> int:
    """Length of the common prefix."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n
    differ = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (differ.bit_length() + 7) // 8


class RadixTree:
    def __init__(self) -> None:
        self.root = Node(b"")

    def insert(self, key: bytes, value: int) -> None:
        above, edge, node, at = None, 0, self.root, 0
        while True:
            path = node.path
            same = len(path) if key.startswith(path, at) else _agree(path, key[at : at + len(path)])
            if same < len(path):  # the compressed path parts here
                upper = Node(path[:same])
                node.path = path[same + 1 :]
                upper.put(path[same], node)
                if above is None:
                    self.root = upper
                else:
                    above.put(edge, upper)
                node = upper
            at += same
            if at == len(key):
                node.value = value
                return
            child = node.find(key[at])
            if child is None:
                node.put(key[at], Node(key[at + 1 :], value))
                return
            above, edge, node, at = node, key[at], child, at + 1

    def along(self, key: bytes):
        """The nodes from the root to the end of a key of the tree."""
        node, at = self.root, 0
        while True:
            yield node
            at += len(node.path)
            if at >= len(key):
                return
            node, at = node.find(key[at]), at + 1


def _prefix_digests(key: bytes) -> list[bytes]:
    """SHA-256 of the first 0, 1, 2, ... turns."""
    h = hashlib.sha256()
    out = [h.digest()]
    for at in range(0, len(key), WIDTH):
        h.update(key[at : at + WIDTH])
        out.append(h.digest())
    return out


def run_nodes(keys: list[bytes], counts: list[int], least: list[int], ends: list[str]):
    """Nodes of one run of distinct ascending keys: (final rows, spine rows).

    A final row: conv_id, depth, parent's conv_id or None, parent's digest if that is a spine node, n_convs, n_children, n_leaves,
    saved_tokens, ends_sha256. A spine row: digest, parent's digest, depth, path (0: first key's, 1: last key's), n_convs, conv_id, children,
    leaves and saved tokens beside the spines, words, ends_sha256. A node on both spines has its values in path 0 and nothing in path 1.
    """
    tree = RadixTree()
    for i, k in enumerate(keys):
        tree.insert(k, i)
    for bit, k in ((1, keys[0]), (2, keys[-1])):
        for node in tree.along(k):
            node.spine |= bit
    order: list[tuple[Node, int, int, int]] = []  # node, its parent's place, byte depths at which its edge begins and ends
    stack = [(tree.root, -1, -WIDTH, len(tree.root.path))]
    while stack:
        node, above, begin, end = stack.pop()
        order.append((node, above, begin, end))
        here = len(order) - 1
        stack.extend((c, here, end, end + 1 + len(c.path)) for c in reversed(node.ordered()))
    total = len(order)
    n, first, sample = [0] * total, [None] * total, [b""] * total
    kids, below_leaves, below_saved, heads, leaves, saved = ([0] * total for _ in range(6))
    for i in range(total - 1, -1, -1):
        node, above, begin, end = order[i]
        if node.value >= 0:
            v = node.value
            n[i] += counts[v]
            sample[i] = keys[v]
            first[i] = least[v] if first[i] is None else min(first[i], least[v])
        kids[i], below_leaves[i], below_saved[i] = heads[i], leaves[i], saved[i]
        if (deep := end // WIDTH) > (up := begin // WIDTH):
            heads[i] = 1
            leaves[i] = leaves[i] or 1
            saved[i] += (n[i] - 1) * sum(int.from_bytes(sample[i][d * WIDTH - 4 : d * WIDTH], "big") for d in range(max(1, up + 1), deep + 1))
        if above >= 0:
            n[above] += n[i]
            first[above] = first[i] if first[above] is None else min(first[above], first[i])
            sample[above] = sample[i]
            heads[above] += heads[i]
            leaves[above] += leaves[i]
            saved[above] += saved[i]
    digests = {1: _prefix_digests(keys[0]), 2: _prefix_digests(keys[-1])}
    final, whole = [], {}
    parent: list[tuple] = [()] * total  # conv_id and spine digest of the deepest node on or above the end of an edge
    for i, (node, above, begin, end) in enumerate(order):
        deep, up = end // WIDTH, begin // WIDTH
        conv, mark = parent[above] if above >= 0 else (None, None)
        rows = []
        sum_saved = below_saved[i]
        for d in range(deep, up, -1):
            words = int.from_bytes(sample[i][d * WIDTH - 4 : d * WIDTH], "big") if d else 0
            sum_saved += (n[i] - 1) * words
            own = ends[node.value] if d == deep and node.value >= 0 else EMPTY_SHA
            rows.append((d, kids[i] if d == deep else 1, leaves[i], sum_saved, words, own))
        for d, n_kids, n_leaves, n_saved, words, own in reversed(rows):
            if node.spine:
                digest = digests[1 if node.spine & 1 else 2][d]
                whole[digest] = (node.spine, d, mark, n[i], first[i], n_kids, n_leaves, n_saved, words, own)
                conv, mark = first[i], digest
            else:
                final.append((first[i], d, None if mark is not None else conv, mark, n[i], n_kids, n_leaves, n_saved, own))
                conv, mark = first[i], None
        parent[i] = (conv, mark)
    spine = []
    under: dict[bytes, list[tuple]] = {}
    for row in whole.values():
        if row[2] is not None:
            under.setdefault(row[2], []).append(row)
    for digest, (on, d, above, count, conv, n_kids, n_leaves, n_saved, words, own) in whole.items():
        hung = under.get(digest, [])
        values = (count, conv, n_kids - len(hung), n_leaves - sum(x[6] for x in hung) - (n_kids == 0), n_saved - (count - 1) * words - sum(x[7] for x in hung), words, own)
        if on & 1:
            spine.append((digest, above, d, 0, *values))
        if on & 2:
            spine.append((digest, above, d, 1, *(values if not on & 1 else (0, None, 0, 0, 0, words, EMPTY_SHA))))
    return final, spine


NODE_SCHEMA = (
    "conv_id long, depth long, parent_conv_id long, parent_digest binary, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, "
    "digest binary, path long, words long"
)


def _tree_rows(batches, run_keys: int, run_bytes: int):
    """Sorted rows (key, n, least, ends) of a partition to node rows, a bounded run at a time."""
    task = TaskContext.get().partitionId()
    schema = pa.schema([(k, {"long": pa.int64(), "binary": pa.binary(), "string": pa.string()}[t]) for k, t in (c.split() for c in NODE_SCHEMA.split(", "))])
    held: tuple[list, list, list, list] = ([], [], [], [])
    size = runs = 0

    def flush():
        final, spine = run_nodes(*held)
        base = ((task << 24) + runs) * 2
        rows = [(*x, None, None, None) for x in final]
        rows += [(conv, d, None, above, count, kids, leaves, saved, own, digest, base + path, words) for digest, above, d, path, count, conv, kids, leaves, saved, words, own in spine]
        for at in range(0, len(rows), 10_000):
            part = rows[at : at + 10_000]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*part), schema)], schema=schema)

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            for to, x in zip(held, row):
                to.append(x)
            size += len(row[0])
            if len(held[0]) >= run_keys or size >= run_bytes:
                yield from flush()
                runs, size, held = runs + 1, 0, ([], [], [], [])
    if held[0]:
        yield from flush()


def _end_digests(batches):
    """Rows (key, chunk, ids, n, least) sorted by key and chunk to one row (key, n, least, ends) for each key."""
    key, h, n, least, started, out = None, hashlib.sha256(), 0, 0, False, []

    def emit(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), (pa.binary(), pa.int64(), pa.int64(), pa.string()))], ["key", "n", "least", "ends"])

    for b in batches:
        for k, ids, count, low in zip(*(b.column(c).to_pylist() for c in ("key", "ids", "n", "least"))):
            if not started or k != key:
                if started:
                    out.append((key, n, least, h.hexdigest()))
                    if len(out) >= 5_000:
                        yield emit(out)
                        out = []
                key, h, n, least, started = k, hashlib.sha256(ids.encode()), count, low, True
            else:
                h.update(b"," + ids.encode())
                n, least = n + count, min(least, low)
    if started:
        yield emit([*out, (key, n, least, h.hexdigest())])


def turn_code(role: Column, text: Column) -> Column:
    """A turn's id in hexadecimal digits; null role or text is empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    digest = F.sha2(F.concat(F.octet_length(role).cast("string"), F.lit(":"), role, text).cast("binary"), 256)
    words = F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+"))
    return F.concat(F.substring(digest, 1, 2 * DIGEST), F.lpad(F.hex(words), 8, "0"))


def rebuilt_sequences(conversations: DataFrame, group: int = 20, shared: int = 4) -> tuple[DataFrame, DataFrame]:
    """((conv_id, key) of every conversation, the staged table it reads): the first crc32(conv_id) % shared turns of conversation
    conv_id - conv_id % group, then its own turns after as many; key is the run of turn ids."""
    turns = conversations.filter("conv_id is not null").select("conv_id", F.struct("turn", turn_code(F.col("role"), F.col("text")).alias("code")).alias("at"))
    turns = stage_table(turns, "turns")
    own = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list("at")).getField("code").alias("own"))
    heads = turns.filter(F.col("conv_id") % group == 0).groupBy(F.col("conv_id").alias("base")).agg(F.slice(F.sort_array(F.collect_list("at")).getField("code"), 1, shared - 1).alias("head"))
    h = (F.crc32(F.col("conv_id").cast("string").cast("binary")) % shared).cast("int")
    both = own.withColumn("h", h).withColumn("base_", F.col("conv_id") - F.col("conv_id") % group).join(heads, F.col("base_") == F.col("base"), "left")
    head = F.slice(F.coalesce("head", F.array().cast("array<string>")), F.lit(1), F.col("h"))
    rest = F.slice("own", F.col("h") + 1, F.greatest(F.size("own") - F.col("h"), F.lit(0)))
    return both.select("conv_id", F.unhex(F.array_join(F.concat(head, rest), "")).alias("key")), turns


def trie_nodes(sequences: DataFrame, run_keys: int = RUN_KEYS, run_bytes: int = RUN_BYTES) -> DataFrame:
    """One row per node of the trie over (conv_id, key): conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256. Empty keys belong to the root; without any sequence there is no node. A tree holds run_keys sequences or run_bytes at most
    (or one longer sequence); the result does not depend on either."""

    def grow(batches):
        yield from _tree_rows(batches, run_keys, run_bytes)

    chunked = sequences.groupBy("key", F.expr(f"shiftright(conv_id, {CHUNK_BITS})").alias("chunk"))
    chunked = chunked.agg(F.array_join(F.sort_array(F.collect_list("conv_id")).cast("array<string>"), ",").alias("ids"), F.count(F.lit(1)).alias("n"), F.min("conv_id").alias("least"))
    streamed = chunked.repartition("key").sortWithinPartitions("key", "chunk").select("key", "ids", "n", "least")
    distinct = stage_table(streamed.mapInArrow(_end_digests, "key binary, n long, least long, ends string"), "sequences")
    ranged = distinct.repartitionByRange("key").sortWithinPartitions("key").select("key", "n", "least", "ends")
    rows = stage_table(ranged.mapInArrow(grow, NODE_SCHEMA), "trie-rows")
    spine = rows.filter("digest is not null")
    merged = spine.groupBy("digest").agg(
        F.first("parent_digest", ignorenulls=True).alias("parent_digest"), F.first("depth").alias("depth"), F.first("words").alias("words"), F.min("path").alias("owner"), F.sum("n_convs").alias("n_convs"),
        F.min("conv_id").alias("conv_id"), F.sum("n_children").alias("kids"), F.sum("n_leaves").alias("leaves"), F.sum("saved_tokens").alias("saved"),
        F.coalesce(F.max(F.when(F.col("ends_sha256") != EMPTY_SHA, F.col("ends_sha256"))), F.lit(EMPTY_SHA)).alias("ends_sha256"),
    )
    merged = stage_table(merged, "trie-spine")
    on_spine = merged.filter("parent_digest is not null").groupBy(F.col("parent_digest").alias("digest")).agg(F.count(F.lit(1)).alias("more"))
    counted = merged.join(on_spine, "digest", "left").withColumn("n_children", F.col("kids") + F.coalesce("more", F.lit(0)))
    counted = counted.withColumns({"leaves": F.col("leaves") + (F.col("n_children") == 0).cast("long"), "saved": F.col("saved") + (F.col("n_convs") - 1) * F.col("words")})
    counted = stage_table(counted.drop("kids", "more", "words"), "trie-counted")
    owned = spine.select("digest", "path", "depth").join(counted.select("digest", "owner", "leaves", "saved"), "digest")
    mine = F.col("path") == F.col("owner")
    suffix = "over (partition by path order by depth desc rows between unbounded preceding and current row)"
    owned = owned.withColumns({"leaves": F.when(mine, F.col("leaves")).otherwise(0), "saved": F.when(mine, F.col("saved")).otherwise(0)})
    sums = owned.select("digest", F.expr(f"sum(leaves) {suffix}").alias("leaves"), F.expr(f"sum(saved) {suffix}").alias("saved"))
    sums = sums.groupBy("digest").agg(F.sum("leaves").alias("n_leaves"), F.sum("saved").alias("saved_tokens"))
    parents = counted.select(F.col("digest").alias("parent_digest"), F.col("conv_id").alias("from_spine"))
    cols = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    tops = counted.join(sums, "digest").join(parents, "parent_digest", "left").withColumn("parent_conv_id", F.col("from_spine"))
    inner = rows.filter("digest is null and parent_digest is null")
    hung = rows.filter("digest is null and parent_digest is not null").drop("parent_conv_id").join(parents, "parent_digest").withColumnRenamed("from_spine", "parent_conv_id")
    return only_result(tops.select(*cols).unionByName(inner.select(*cols)).unionByName(hung.select(*cols)), "trie", distinct, rows, merged, counted)


def conversation_trie(conversations: DataFrame, group: int = 20, shared: int = 4, run_keys: int = RUN_KEYS) -> DataFrame:
    """The trie of the rebuilt conversations of (conv_id, turn, role, text).

    Turns go by `turn`, null first; equal ones by their SHA-256. Rows that repeat are turns of their own, rows with a null conv_id belong to no
    conversation, null role or text is empty, other columns are ignored, and an empty table gives no node.
    """
    sequences, turns = rebuilt_sequences(conversations, group, shared)
    out = trie_nodes(sequences, run_keys)
    drop_staged(turns)
    return out


def op12_conversation_trie(spark, sf_dir: str) -> DataFrame:
    """Every node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256. Nulls, ties and repeated rows as
    in conversation_trie."""
    return conversation_trie(read_table(spark, sf_dir, "conversations"))


QUERIES = {"op12_conversation_trie": op12_conversation_trie}
ORACLE: dict[str, str] = {
    "op12_conversation_trie": r"""
        WITH turns AS (
            SELECT conv_id AS c, coalesce(text, '') AS text, sha256(strlen(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS code,
                   row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, code) AS p
            FROM conversations WHERE conv_id IS NOT NULL
        ), convs AS (
            SELECT c, c - c % 20 AS base, n, xor(4294967295, list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split(c::VARCHAR, ''), lambda z: ascii(z)::BIGINT)),
                   lambda a, b: list_reduce(list_concat([xor(a, b)], range(8)), lambda u, k: CASE WHEN u & 1 = 1 THEN xor(u >> 1, 3988292384) ELSE u >> 1 END))) % 4 AS h
            FROM (SELECT c, count(*) AS n FROM turns GROUP BY c)
        ), headed AS (
            SELECT v.*, least(v.h, coalesce(b.n, 0)) AS k FROM convs v LEFT JOIN convs b ON b.c = v.base
        ), rebuilt AS (
            SELECT v.c, t.p, t.text, t.code FROM headed v JOIN turns t ON t.c = v.base AND t.p <= v.k
            UNION ALL
            SELECT v.c, v.k + t.p - v.h, t.text, t.code FROM headed v JOIN turns t ON t.c = v.c AND t.p > v.h
        ), members AS (
            SELECT c, p AS depth, sha256(string_agg(code, '') OVER w) AS path, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) AS words,
                   p = max(p) OVER (PARTITION BY c) AS ends
            FROM rebuilt WINDOW w AS (PARTITION BY c ORDER BY p)
            UNION ALL
            SELECT c, 0, sha256(''), 0, c NOT IN (SELECT c FROM rebuilt) FROM convs
        ), nodes AS (
            SELECT path, depth, min(c) AS conv_id, count(*) AS n_convs, max(words) AS words,
                   sha256(coalesce(string_agg(c::VARCHAR, ',' ORDER BY c) FILTER (WHERE ends), '')) AS ends_sha256
            FROM members GROUP BY path, depth
        ), linked AS (
            SELECT n.*, u.path AS parent_path FROM nodes n
            LEFT JOIN members m ON m.c = n.conv_id AND m.depth = n.depth - 1 LEFT JOIN nodes u ON u.path = m.path AND u.depth = m.depth
        ), counted AS (
            SELECT l.*, coalesce(k.n, 0) AS n_children FROM linked l LEFT JOIN (SELECT parent_path, count(*) AS n FROM linked GROUP BY 1) k ON k.parent_path = l.path
        ), suffixes AS (
            SELECT m.path, m.depth, sum(CASE WHEN n.conv_id = m.c AND n.n_children = 0 THEN 1 ELSE 0 END) OVER w AS leaves,
                   sum(CASE WHEN n.conv_id = m.c THEN (n.n_convs - 1) * n.words ELSE 0 END) OVER w AS saved
            FROM members m JOIN counted n ON n.path = m.path AND n.depth = m.depth WINDOW w AS (PARTITION BY m.c ORDER BY m.depth DESC)
        ), sums AS (
            SELECT path, depth, sum(leaves) AS leaves, sum(saved) AS saved FROM suffixes GROUP BY path, depth
        )
        SELECT n.conv_id, n.depth::BIGINT AS depth, u.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.leaves::BIGINT AS n_leaves,
               s.saved::BIGINT AS saved_tokens, n.ends_sha256
        FROM counted n JOIN sums s ON s.path = n.path AND s.depth = n.depth LEFT JOIN nodes u ON u.path = n.parent_path
    """
}
