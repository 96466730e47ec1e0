"""Sequential and dense network operators: one NumPy kernel call for each (recording, lag, replicate), spread by Spark over a batch.

A network is one recording's channels (tens to thousands of nodes), so a group is bounded by the instrument, not by the data set; the batch
of recordings, lags and replicates is what grows, and that is the grouping key. Replicates are seeded by hashes of their keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import _parse_datatype_string


def _kinds(df: DataFrame, keys: list[str]) -> str:
    return ", ".join(f"{k} {df.schema[k].dataType.simpleString()}" for k in keys)


def _node_kind(df: DataFrame) -> str:
    return df.schema["src"].dataType.simpleString()


def matrix(pdf: pd.DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(nodes in order, symmetric weights) of an edge frame."""
    nodes = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]))
    w = np.zeros((len(nodes), len(nodes)))
    i, j = np.searchsorted(nodes, pdf["src"].to_numpy()), np.searchsorted(nodes, pdf["dst"].to_numpy())
    w[i, j] = w[j, i] = pdf["w"].to_numpy()
    np.fill_diagonal(w, 0)
    return nodes, w


def seed_of(*parts) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def _per_network(edges: DataFrame, keys: list[str], columns: str, fn) -> DataFrame:
    """fn(nodes, weights, key values) -> dict of columns, for every network."""
    names = [c.split()[0] for c in columns.split(", ")]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        nodes, w = matrix(pdf)
        out = pd.DataFrame(fn(nodes, w, [pdf[k].iloc[0] for k in keys]))
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, *names]]

    return edges.select(*keys, "src", "dst", "w").groupBy(*keys).applyInPandas(run, f"{_kinds(edges, keys)}, {columns}")


def replicated(edges: DataFrame, reps: int, name: str = "rep") -> DataFrame:
    """Every network `reps` times, so that replicates become groups of their own."""
    return edges.withColumn(name, F.explode(F.sequence(F.lit(1), F.lit(reps))))


# ---- communities -------------------------------------------------------------------------------------------------------------------


def _move_nodes(near: list[dict[int, float]], strength: list[float], total: float, gamma: float, rng: np.random.RandomState) -> tuple[list[int], bool]:
    """Local moves over neighbour lists: nodes in random order go to the neighbouring community of the largest gain until none moves."""
    home, weight_of = list(range(len(near))), list(strength)
    queue, waiting, any_move = list(rng.permutation(len(near))), set(range(len(near))), False
    while queue:
        u = queue.pop()
        waiting.discard(u)
        links: dict[int, float] = {}
        for v, w in near[u].items():
            if v != u:
                links[home[v]] = links.get(home[v], 0.0) + w
        here = home[u]
        weight_of[here] -= strength[u]
        stay = links.get(here, 0.0) - gamma * strength[u] * weight_of[here] / total
        best, most = here, stay + 1e-10 * total
        for c in sorted(links):
            gain = links[c] - gamma * strength[u] * weight_of[c] / total
            if gain > most:
                best, most = c, gain
        home[u] = best
        weight_of[best] += strength[u]
        if best != here:
            any_move = True
            for v in near[u]:  # only neighbours elsewhere can gain by this
                if home[v] != best and v not in waiting:
                    waiting.add(v)
                    queue.insert(0, v)
    return home, any_move


def louvain_labels(w: np.ndarray, gamma: float, rng: np.random.RandomState) -> np.ndarray:
    """Communities 0.. by local moves and merging of communities into nodes, until no node moves."""
    near = [{int(v): float(row[v]) for v in np.flatnonzero(row)} for row in w]
    strength = [float(x) for x in w.sum(axis=1)]
    total, label = sum(strength), np.arange(len(w))
    while total > 0:
        home, moved = _move_nodes(near, strength, total, gamma, rng)
        if not moved:
            break
        names = {c: i for i, c in enumerate(dict.fromkeys(home))}
        label = np.array([names[home[x]] for x in label])
        merged, sums = [{} for _ in names], [0.0] * len(names)
        for u, around in enumerate(near):
            a = names[home[u]]
            sums[a] += strength[u]
            for v, x in around.items():
                b = names[home[v]]
                merged[a][b] = merged[a].get(b, 0.0) + x
        near, strength = merged, sums
    return label


def louvain(edges: DataFrame, keys: list[str], gamma: float = 1.0, seed: int = 1) -> DataFrame:
    def fn(nodes, w, key):
        return {"node": nodes, "community": louvain_labels(w, gamma, np.random.RandomState(seed_of(seed, *key))) + 1}

    return _per_network(edges, keys, f"node {_node_kind(edges)}, community int", fn)


def consensus_communities(edges: DataFrame, keys: list[str], runs: int = 50, threshold: float = 0.4, max_rounds: int = 50, seed: int = 1) -> DataFrame:
    """Louvain repeated; co-assignment shares above the threshold form the next network, until all runs agree."""

    def fn(nodes, w, key):
        now = w
        for r in range(max_rounds):
            runs_ = np.stack([louvain_labels(now, 1.0, np.random.RandomState(seed_of(seed, r, i, *key))) for i in range(runs)])
            together = (runs_[:, :, None] == runs_[:, None, :]).mean(0)
            if ((together == 0) | (together == 1)).all():
                break
            now = np.where(together >= threshold, together, 0)
            np.fill_diagonal(now, 0)
        return {"node": nodes, "community": np.unique(runs_[0], return_inverse=True)[1] + 1}

    return _per_network(edges, keys, f"node {_node_kind(edges)}, community int", fn)


# ---- distances ---------------------------------------------------------------------------------------------------------------------

#: Distances that a piece of output holds at most, but for one source's.
PIECE_DISTANCES = 1 << 21
#: Ways of few different lengths go by levels, unless there are more levels than this.
MOST_LENGTHS, MOST_LEVELS = 8, 512


def _distance_blocks(arcs: DataFrame, keys: list[str], columns: str, fn) -> DataFrame:
    """(keys, columns) from fn(heads, tails, lengths, sources, nodes) -> pieces, as dicts of arrays. arcs (keys, src, dst, d) are parted by component.
    A component's sources are dealt into blocks by its share of the work, each with all its arcs: blocks are about four for each core in all,
    whatever the number of pairs, so that copies of arcs don't grow with it."""
    from ..functions.iterate import cut
    from .network import components

    kinds, spark = f"{_kinds(arcs, keys)}, {columns}", arcs.sparkSession
    names, keys = keys, [f"__k{i}" for i in range(len(keys))]  # a key may be called node
    arcs = cut(arcs.withColumnsRenamed(dict(zip(names, keys))))
    home = cut(components(arcs.select(*keys, "src", "dst", F.lit(1.0).alias("w")), keys))
    parts = arcs.join(home.withColumnRenamed("node", "src"), [*keys, "src"])
    tasks = 4 * spark.sparkContext.defaultParallelism
    size = home.groupBy(*keys, "component").agg((F.count(F.lit(1)) * F.count(F.lit(1)).cast("double")).alias("__n"))
    total = size.agg(F.sum("__n")).first()[0] or 1.0
    large = size.withColumn("blocks", F.ceil(F.col("__n") * tasks / total).cast("int")).filter("blocks > 1").drop("__n")  # at most one for each task
    parts = parts.join(F.broadcast(large), [*keys, "component"], "left").withColumn("blocks", F.coalesce("blocks", F.lit(1))).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    schema = pa.schema([pa.field(f.name, to_arrow_type(f.dataType)) for f in _parse_datatype_string(kinds).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(list(batches))
        key = [table[k][0] for k in keys]
        block, blocks = table["block"][0].as_py(), table["blocks"][0].as_py()
        heads, tails, lengths = (table[c].to_numpy() for c in ("src", "dst", "d"))
        del table
        nodes, ends = np.unique(np.concatenate([heads, tails]), return_inverse=True)
        order = np.argsort(ends[len(heads) :], kind="stable")
        heads, tails, lengths = ends[: len(heads)][order], ends[len(heads) :][order], lengths[order]
        for piece in fn(heads, tails, lengths, np.arange(block, len(nodes), blocks), nodes):
            n = len(next(iter(piece.values())))
            yield pa.RecordBatch.from_arrays([*(pa.repeat(k, n).cast(f.type) for k, f in zip(key, schema)), *(pa.array(piece[f.name], f.type) for f in list(schema)[len(key) :])], schema=schema)

    dealt = parts.select(*keys, "component", "block", "blocks", "src", "dst", "d").repartition(4 * tasks, *keys, "component", "block")
    return dealt.groupBy(*keys, "component", "block").applyInArrow(run, kinds)


def _levels(classes, some, n):
    """(distance, nodes, bits) in rising order: at which distance nodes are first reached, a bit for each of up to 64 sources. classes: _of_length of
    every length. Sums of the same lengths in another order, which differ in the last digits only, are one distance."""
    seen, due = np.zeros(n, np.uint64), {}
    seen[some] = front = np.uint64(1) << np.arange(len(some), dtype=np.uint64)
    at, now, everyone = 0.0, np.asarray(some), np.uint64((1 << len(some)) - 1)
    while True:
        whole = np.zeros(n, np.uint64)
        whole[now] = front
        for length, heads, to, starts, first, ends in classes:
            size = first[now + 1] - first[now]
            if 16 * (total := int(size.sum())) < len(heads):  # few arcs begin here: only these
                got_to = ends[np.repeat(first[now] - np.cumsum(size) + size, size) + np.arange(total)]
                order = np.argsort(got_to, kind="stable")
                got_to, bits = got_to[order], np.repeat(front, size)[order]
                begin = np.flatnonzero(np.diff(got_to, prepend=-1))
                got_to, got = got_to[begin], np.bitwise_or.reduceat(bits, begin) if total else bits
            else:
                got_to, got = to, np.bitwise_or.reduceat(whole[heads], starts)
            got = got & ~seen[got_to]
            hit = np.flatnonzero(got)
            if len(hit):
                due.setdefault(at + length, []).append((got_to[hit], got[hit]))
        while due:
            at = min(due)
            whole = np.zeros(n, np.uint64)
            for x in [x for x in due if x <= at * (1 + 1e-14)]:
                for to, got in due.pop(x):
                    whole[to] |= got
            whole &= ~seen
            now = np.flatnonzero(whole)
            if len(now):
                break
        else:
            return
        front = whole[now]
        seen[now] |= front
        yield at, now, front
        if (seen == everyone).all():
            return


def _of_length(length, heads, tails, n):
    """The arcs of one length: that, heads in order of tails, the tails and where each begins; where the arcs of each head begin, tails by head."""
    starts = np.flatnonzero(np.diff(tails, prepend=-1))
    return float(length), heads, tails[starts], starts, np.concatenate([[0], np.cumsum(np.bincount(heads, minlength=n))]), tails[np.argsort(heads, kind="stable")]


def _bits(words, k: int):
    """Of every word its k lowest bits, as a row of 0 and 1."""
    return np.unpackbits(words.astype("<u8").view(np.uint8).reshape(len(words), 8), axis=1, bitorder="little")[:, :k]


def _from_sources(heads, tails, lengths, sources, n):
    """(sources, distances from each of them to all nodes or None, levels as of _levels or None), some sources at a time."""
    if len(kinds := np.unique(lengths)) <= MOST_LENGTHS and (kinds > 0).all():
        classes = [_of_length(x, heads[at], tails[at], n) for x in kinds for at in [lengths == x]]
        while len(sources):
            some, levels = sources[:64], []
            for level in _levels(classes, some, n):
                levels.append(level)
                if len(levels) > MOST_LEVELS:
                    break
            else:
                yield some, None, levels
                sources = sources[64:]
                continue
            break
    if len(sources):
        for some, d in _relaxed(heads, tails, lengths, sources, n):
            yield some, d, None


def _relaxed(heads, tails, lengths, sources, n):
    """Distances by rounds over all arcs, which end at tails in order, until none shortens a way; some sources at a time."""
    starts = np.flatnonzero(np.diff(tails, prepend=-1))
    to = tails[starts]
    for some in np.array_split(sources, -(-len(sources) // max(1, min(64, (1 << 22) // len(heads))))):
        d = np.full((n, len(some)), np.inf)
        d[some, np.arange(len(some))] = 0
        while True:
            new = np.minimum(np.minimum.reduceat(d[heads] + lengths[:, None], starts, axis=0), d[to])
            if (new == d[to]).all():
                break
            d[to] = new
        yield some, d.T


def _pairs(heads, tails, lengths, sources, nodes):
    n = len(nodes)
    for some, d, levels in _from_sources(heads, tails, lengths, sources, n):
        if d is None:
            d = np.full((n, len(some)), np.inf)
            for at, now, front in levels:
                i, j = np.nonzero(_bits(front, len(some)))
                d[now[i], j] = at
            d = d.T
        for a in range(0, len(some), step := max(1, PIECE_DISTANCES // n)):
            part, own = np.array(d[a : a + step]), some[a : a + step]
            part[np.arange(len(own)), own] = np.inf
            i, j = np.nonzero(np.isfinite(part))
            yield {"src": nodes[own[i]], "dst": nodes[j], "d": part[i, j]}


def _sums(heads, tails, lengths, sources, nodes):
    for some, d, levels in _from_sources(heads, tails, lengths, sources, len(nodes)):
        if d is None:
            far, close, reached = np.zeros(len(some)), np.zeros(len(some)), np.zeros(len(some), np.int64)
            for at, _, front in levels:
                n = np.add.reduce(_bits(front, len(some)), axis=0, dtype=np.int64)
                far, close, reached = far + n * at, close + n / at, reached + n
        else:
            d = np.array(d)
            d[np.arange(len(some)), some] = np.inf
            with np.errstate(divide="ignore"):
                far, close, reached = np.where(np.isfinite(d), d, 0).sum(1), (1 / d).sum(1), np.isfinite(d).sum(1)
        yield {"src": nodes[some], "far": far, "close": close, "reached": reached}


def distances(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, d) of all reachable ordered pairs, src <> dst: least sum of the lengths d of arcs (keys, src, dst, d), which are not negative."""
    return _distance_blocks(arcs.select(*keys, "src", "dst", F.col("d").cast("double").alias("d")), keys, f"src {_node_kind(arcs)}, dst {_node_kind(arcs)}, d double", _pairs)


def distance_sums(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, far, close, reached): of the distances of every node to the others that it reaches, their sum, that of 1 / d and their number. Pairs
    are not listed; a node that reaches none has no row or a row of 0."""
    return _distance_blocks(arcs.select(*keys, "src", "dst", F.col("d").cast("double").alias("d")), keys, f"src {_node_kind(arcs)}, far double, close double, reached long", _sums)


def arc_counts(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, d) of all reachable ordered pairs, src <> dst: least number of arcs."""
    return _distance_blocks(arcs.select(*keys, "src", "dst", F.lit(1).alias("d")), keys, f"src {_node_kind(arcs)}, dst {_node_kind(arcs)}, d int", _pairs)


# ---- centrality --------------------------------------------------------------------------------------------------------------------


def _brandes(length: np.ndarray, sources, edge: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Node (and edge) betweenness over the given sources, on a dense matrix of lengths (inf where there is no edge)."""
    n = len(length)
    node, arcs = np.zeros(n), np.zeros((n, n))
    for s in sources:
        d, paths, done, order = np.full(n, np.inf), np.zeros(n), np.zeros(n, bool), []
        d[s], paths[s] = 0, 1
        before = np.zeros((n, n), bool)
        for _ in range(n):
            u = int(np.where(done, np.inf, d).argmin())
            if done[u] or not np.isfinite(d[u]):
                break
            done[u] = True
            order.append(u)
            nd = d[u] + length[u]
            shorter, equal = ~done & (nd < d - 1e-12), ~done & np.isfinite(nd) & (np.abs(nd - d) <= 1e-12)
            before[shorter] = False
            before[shorter, u] = before[equal, u] = True
            paths[shorter], d[shorter] = paths[u], nd[shorter]
            paths[equal] += paths[u]
        load = np.zeros(n)
        for v in reversed(order[1:]):
            p = np.flatnonzero(before[v])
            share = (1 + load[v]) * paths[p] / paths[v]
            load[p] += share
            arcs[p, v] += share
            node[v] += load[v]
    return node, arcs


def betweenness(edges: DataFrame, keys: list[str], offset: float = 0.01, blocks: int = 8) -> DataFrame:
    """(keys, node, bc): betweenness on lengths 1 / (w + offset) over all pairs (zeros too), over (n-1)(n-2). Sources are dealt into blocks, each
    a group of its own, and Spark adds them up. offset 0: only edges carry paths."""
    e = replicated(edges, blocks, "block")

    def fn(nodes, w, key):
        with np.errstate(divide="ignore"):
            length = 1 / (w + offset)
        np.fill_diagonal(length, np.inf)
        n = len(nodes)
        part, _ = _brandes(length, range(key[-1] - 1, n, blocks))
        return {"node": nodes, "part": part / max(1, (n - 1) * (n - 2))}

    return _per_network(e, [*keys, "block"], f"node {_node_kind(edges)}, part double", fn).groupBy(*keys, "node").agg(F.sum("part").alias("bc"))


def edge_betweenness(edges: DataFrame, keys: list[str], binary: bool = False, blocks: int = 8) -> DataFrame:
    """(keys, src, dst, eb) of every edge, both directions added."""
    e = replicated(edges, blocks, "block")

    def fn(nodes, w, key):
        with np.errstate(divide="ignore"):
            length = np.where(w > 0, 1.0 if binary else 1 / w, np.inf)
        arcs = _brandes(length, range(key[-1] - 1, len(nodes), blocks))[1]
        i, j = np.nonzero(np.triu(w))
        return {"src": nodes[i], "dst": nodes[j], "part": arcs[i, j] + arcs[j, i]}

    kind = _node_kind(edges)
    return _per_network(e, [*keys, "block"], f"src {kind}, dst {kind}, part double", fn).groupBy(*keys, "src", "dst").agg(F.sum("part").alias("eb"))


def eigenvector_centrality(edges: DataFrame, keys: list[str]) -> DataFrame:
    return _per_network(edges, keys, f"node {_node_kind(edges)}, ec double", lambda nodes, w, key: {"node": nodes, "ec": np.abs(np.linalg.eigh(w)[1][:, -1])})


def communicability(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, communicability): row sums of the matrix exponential of the weights, scaled to 0..1."""

    def fn(nodes, w, key):
        val, vec = np.linalg.eigh(w)
        g = vec @ np.diag(np.exp(val)) @ vec.T
        g = (g - g.min()) / max(g.max() - g.min(), 1e-300)
        return {"node": nodes, "communicability": g.sum(1)}

    return _per_network(edges, keys, f"node {_node_kind(edges)}, communicability double", fn)


def controllability(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, average, modal) of the weights over 1 + their largest singular value."""

    def fn(nodes, w, key):
        val, vec = np.linalg.eigh(w / (1 + np.abs(np.linalg.eigvalsh(w)).max()))
        sq = vec**2
        return {"node": nodes, "average": sq @ (1 / (1 - val**2)), "modal": sq @ (1 - val**2)}

    return _per_network(edges, keys, f"node {_node_kind(edges)}, average double, modal double", fn)


# ---- null networks -----------------------------------------------------------------------------------------------------------------


def swap_edges(w: np.ndarray, rng: np.random.RandomState, swaps: int, distance: np.ndarray | None = None) -> np.ndarray:
    """Double-edge swaps that keep every node's number of edges and the multiset of weights; `swaps` times, each looking for a pair of edges
    at most 1 + twice the mean number of edges of a node and edge times (an unlucky search ends the swap, a network without any pair the work).

    Edges a-b and c-d become a-d and c-b, keeping their weights, where neither is there yet. With a distance between nodes, only swaps after
    which weight times distance adds up to no more than before are made, so the network moves towards a lattice over that distance.
    """
    i, j = (x.tolist() for x in np.nonzero(np.triu(w)))
    m, n, out = len(i), len(w), w.tolist()
    if m < 2:
        return w.copy()
    far = None if distance is None else distance.tolist()
    tries = 1 + round((2 if far else 1) * m / (n - 1))
    draws, at = [], 0
    for _ in range(swaps):
        for _ in range(tries):
            if at == len(draws):
                draws, at = list(zip(rng.randint(0, m, 4096).tolist(), rng.randint(0, m, 4096).tolist(), (rng.rand(4096) < 0.5).tolist())), 0
            e, f, flip = draws[at]
            at += 1
            a, b = i[e], j[e]
            c, d = (j[f], i[f]) if flip else (i[f], j[f])
            if a == c or a == d or b == c or b == d or out[a][d] or out[c][b]:
                continue
            x, y = out[a][b], out[c][d]
            if far and far[a][b] * x + far[c][d] * y < far[a][d] * x + far[c][b] * y:
                continue
            out[a][b] = out[b][a] = out[c][d] = out[d][c] = 0.0
            out[a][d] = out[d][a] = x
            out[c][b] = out[b][c] = y
            i[e], j[e], i[f], j[f] = a, d, c, b
            break
    return np.array(out)


def swap_signed(w: np.ndarray, rng: np.random.RandomState, sweeps: int = 5) -> np.ndarray:
    """Swaps among pairs of nodes that are positive, negative or absent: every node keeps its number of each, and weights their multisets.

    Four different nodes a, b, c, d are drawn; if a-b and c-d are in one state, a-d and c-b in one state, and the two states differ, the two
    pairs of pairs trade places. There are `sweeps` swaps for each pair of nodes, each with 1 + half the nodes draws at most.
    """
    n = len(w)
    state = np.sign(w)
    if n < 4 or len(np.unique(state[np.triu_indices(n, 1)])) < 2:
        return w.copy()
    out, tries = w.tolist(), 1 + round(n / 2)
    kind = state.astype(int).tolist()
    draws, at = [], 0
    for _ in range(sweeps * n * (n - 1) // 2):
        for _ in range(tries):
            if at == len(draws):
                draws, at = rng.randint(0, n, (8192, 4)).tolist(), 0
            a, b, c, d = draws[at]
            at += 1
            if a == b or a == c or a == d or b == c or b == d or c == d:
                continue
            one, other = kind[a][b], kind[a][d]
            if one == other or kind[c][d] != one or kind[c][b] != other:
                continue
            for table in (out, kind):
                ab, cd, ad, cb = table[a][b], table[c][d], table[a][d], table[c][b]
                table[a][d] = table[d][a] = ab
                table[a][b] = table[b][a] = ad
                table[c][b] = table[b][c] = cd
                table[c][d] = table[d][c] = cb
            break
    return np.array(out)


def reassign_weights(topology: np.ndarray, w: np.ndarray, rng: np.random.RandomState, batch: int = 10) -> np.ndarray:
    """The weights of w on the edges of topology so that node strengths stay close, for positive and negative edges by themselves: ranks are
    matched with the product of the strengths still owed, `batch` edges at a time. topology has as many edges of each sign as w."""
    out = np.zeros_like(w)
    for sign in (1, -1):
        part = np.maximum(sign * w, 0)
        i, j = np.nonzero(np.triu(sign * topology > 0))
        weights, owed = np.sort(part[np.triu(part) > 0]), part.sum(1)
        while len(i):
            order = np.argsort(owed[i] * owed[j], kind="stable")
            pick = rng.permutation(len(i))[: min(batch, len(i))]
            e = order[pick]
            out[i[e], j[e]] = out[j[e], i[e]] = sign * weights[pick]
            np.subtract.at(owed, i[e], weights[pick])
            np.subtract.at(owed, j[e], weights[pick])
            owed = np.maximum(owed, 0)
            i, j, weights = np.delete(i, e), np.delete(j, e), np.delete(weights, pick)
    return out


def profile_distance(w: np.ndarray) -> np.ndarray:
    """Euclidean distance between the rows of w: nodes are close if they are connected alike."""
    square = (w * w).sum(1)
    return np.sqrt(np.maximum(square[:, None] + square[None] - 2 * w @ w.T, 0))


#: Swaps of random and of lattice networks.
RANDOM_SWAPS, LATTICE_SWAPS = 5_000, 10_000


def null_networks(edges: DataFrame, keys: list[str], reps: int, kind: str = "strength", seed: int = 1, sweeps: int = 5, swaps: int | None = None) -> DataFrame:
    """Edges of `reps` null networks: keys, rep, src, dst, w. kind:

    swap: `swaps` double-edge swaps (RANDOM_SWAPS). lattice: LATTICE_SWAPS swaps towards the connectivity profiles' distance. signed: swaps
    among positive, negative and absent pairs, `sweeps` for each pair. strength: the same, then weights put back by strength, signs apart.
    All keep every node's number of edges and the multiset of weights; the last two keep both for each sign.
    """
    if kind not in ("swap", "lattice", "signed", "strength"):
        raise ValueError(kind)

    def fn(nodes, w, key):
        rng = np.random.RandomState(seed_of(seed, kind, *key))
        if kind == "swap":
            out = swap_edges(w, rng, swaps or RANDOM_SWAPS)
        elif kind == "lattice":
            out = swap_edges(w, rng, swaps or LATTICE_SWAPS, profile_distance(w))
        else:
            out = swap_signed(w, rng, sweeps)
            if kind == "strength":
                out = reassign_weights(out, w, rng)
        i, j = np.nonzero(np.triu(out))
        return {"src": nodes[i], "dst": nodes[j], "w": out[i, j]}

    k = _node_kind(edges)
    return _per_network(replicated(edges, reps), [*keys, "rep"], f"src {k}, dst {k}, w double", fn)


def normalised_participation(edges: DataFrame, communities: DataFrame, keys: list[str], reps: int = 100, seed: int = 1) -> DataFrame:
    """(keys, node, pc_norm) = 1 - median over null networks of sqrt(half the summed squared differences of strength shares by community)."""
    from .connectivity import both_ways

    c = communities.select(*keys, F.col("node").alias("dst"), "community")
    k = both_ways(edges, keys).groupBy(*keys, F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    real = both_ways(edges, keys).join(c, [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node"), "community").agg(F.sum("w").alias("m")).withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    null = both_ways(null_networks(edges, keys, reps, "strength", seed), [*keys, "rep"]).join(c, [*keys, "dst"]).groupBy(*keys, "rep", F.col("src").alias("node"), "community").agg((-F.sum("w")).alias("m"))
    diff = real.unionByName(null.select(*real.columns)).groupBy(*keys, "rep", "node", "community").agg(F.sum("m").alias("m")).join(k, [*keys, "node"])
    per = diff.groupBy(*keys, "rep", "node").agg(F.sqrt(0.5 * F.sum((F.col("m") / F.col("k")) ** 2)).alias("x"))
    return per.groupBy(*keys, "node").agg((1 - F.percentile("x", F.lit(0.5))).alias("pc_norm"))


def small_worldness(edges: DataFrame, keys: list[str], seed: int = 1) -> DataFrame:
    """(keys, sigma, omega, cc_norm, pl_norm) against one random and one lattice null network, with relational metrics on all three."""
    from .network import clustering, path_metrics, shortest_paths

    nets = edges.select(*keys, "src", "dst", "w").withColumn("net", F.lit("a"))
    for kind, name in (("swap", "r"), ("lattice", "l")):
        nets = nets.unionByName(null_networks(edges, keys, 1, kind, seed).drop("rep").withColumn("net", F.lit(name)))
    k = [*keys, "net"]
    from ..functions.iterate import cut

    nets = cut(nets)
    nodes = nets.select(*k, F.col("src").alias("node")).unionByName(nets.select(*k, F.col("dst").alias("node"))).distinct()
    cc = clustering(nets, k).groupBy(*k).agg(F.avg("cc").alias("cc"))
    pl = path_metrics(shortest_paths(nets, k), nodes, k).select(*k, "path_length")
    g = cc.join(pl, k).groupBy(*keys).agg(*(F.max(F.when(F.col("net") == n, F.col(c))).alias(f"{c}_{n}") for n in "arl" for c in ("cc", "path_length")))
    cn, pn, cl = F.try_divide(F.col("cc_a"), F.col("cc_r")), F.try_divide(F.col("path_length_a"), F.col("path_length_r")), F.try_divide(F.col("cc_a"), F.col("cc_l"))
    return g.select(*keys, F.try_divide(cn, pn).alias("sigma"), (F.try_divide(F.col("path_length_r"), F.col("path_length_a")) - cl).alias("omega"), cl.alias("cc_norm"), pn.alias("pl_norm"))


# ---- activity matrices -------------------------------------------------------------------------------------------------------------


def effective_rank(frames: DataFrame, keys=("rec",), unit: str = "roi", time: str = "frame", value: str = "f") -> DataFrame:
    """(keys, rank): exp of the entropy of the eigenvalues of the covariance between units; covariances are a native self join."""
    keys = list(keys)
    a = frames.select(*keys, F.col(time).alias("__t"), F.col(unit).alias("src"), F.col(value).alias("x"))
    b = frames.select(*keys, F.col(time).alias("__t"), F.col(unit).alias("dst"), F.col(value).alias("y"))
    cov = a.join(b, [*keys, "__t"]).filter("src <= dst").groupBy(*keys, "src", "dst").agg(F.covar_samp("x", "y").alias("w"))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        units = np.unique(pdf[["src", "dst"]].to_numpy())
        m = np.zeros((len(units),) * 2)
        i, j = np.searchsorted(units, pdf["src"]), np.searchsorted(units, pdf["dst"])
        m[i, j] = m[j, i] = pdf["w"].fillna(0)
        lam = np.clip(np.linalg.eigvalsh(m), 0, None)
        p = lam[lam > 0] / lam.sum() if lam.sum() > 0 else np.array([])
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "rank": [float(np.exp(-(p * np.log(p)).sum())) if len(p) else None]})

    return cov.groupBy(*keys).applyInPandas(run, f"{_kinds(frames, keys)}, rank double")


def _nmf_residual(x: np.ndarray, k: int, rng, iterations: int = 200) -> float:
    w, h = rng.rand(x.shape[0], k) + 1e-3, rng.rand(k, x.shape[1]) + 1e-3
    for _ in range(iterations):
        h *= (w.T @ x) / (w.T @ w @ h + 1e-12)
        w *= (x @ h.T) / (w @ h @ h.T + 1e-12)
    return float(np.sqrt(((x - w @ h) ** 2).mean()))


def nmf_components(counts: DataFrame, keys=("rec",), seed: int = 1) -> DataFrame:
    """(keys, components): ranks before the residual of real counts (keys, ch, bin, n) reaches that of counts shuffled in time.

    Ranks go from 1 to the number of active channels. Every (network, rank, real or shuffled) is a group, so the sweep runs side by side;
    the stop rule is a native minimum.
    """
    keys = list(keys)
    active = counts.groupBy(*keys, "ch").agg(F.sum("n").alias("s")).filter("s > 1").drop("s")
    ranks = active.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("ranks"))
    c = counts.join(active, [*keys, "ch"]).join(ranks, keys).withColumn("k", F.explode(F.sequence(F.lit(1), "ranks"))).withColumn("shuffled", F.explode(F.array(F.lit(False), F.lit(True))))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key = [pdf[k].iloc[0] for k in keys]
        k, shuffled = int(pdf["k"].iloc[0]), bool(pdf["shuffled"].iloc[0])
        rows, cols = (np.unique(pdf[c], return_inverse=True)[1] for c in ("bin", "ch"))
        x = np.zeros((rows.max() + 1, cols.max() + 1))
        x[rows, cols] = pdf["n"]
        rng = np.random.RandomState(seed_of(seed, *key))
        if shuffled:
            x = np.stack([rng.permutation(col) for col in x.T], axis=1)
        res = _nmf_residual(x, k, np.random.RandomState(seed_of(seed, k, *key))) if k <= min(x.shape) else None
        return pd.DataFrame({**{n: [v] for n, v in zip(keys, key)}, "k": [k], "shuffled": [shuffled], "res": [res]})

    got = c.groupBy(*keys, "k", "shuffled").applyInPandas(run, f"{_kinds(counts, keys)}, k int, shuffled boolean, res double")
    pair = got.groupBy(*keys, "k").agg(F.max(F.when(~F.col("shuffled"), F.col("res"))).alias("a"), F.max(F.when(F.col("shuffled"), F.col("res"))).alias("b"))
    stop = pair.filter("a is null or a >= b").groupBy(*keys).agg(F.min("k").alias("stop"))
    return ranks.join(stop, keys, "left").select(*keys, (F.coalesce("stop", F.col("ranks") + 1) - 1).alias("components"))


def nmf_variance(counts: DataFrame, bins: int, keys=("rec",), seed: int = 1, least: int = 1) -> DataFrame:
    """(keys, k, active, residual, explained): factorisations of the counts (keys, ch, bin, n) of channels with more than `least` events, over
    `bins` time bins, at every rank k from 1 to the number of those channels. residual is the root mean square error, explained the share of
    the variance around the grand mean; bins without a row are zeros. Every (network, rank) is a group, so a sweep runs side by side."""
    keys = list(keys)
    active = counts.groupBy(*keys, "ch").agg(F.sum("n").alias("s")).filter(F.col("s") > least).drop("s")
    size = active.groupBy(*keys).agg(F.count(F.lit(1)).cast("int").alias("active"))
    c = counts.join(active, [*keys, "ch"]).join(size, keys).withColumn("k", F.explode(F.sequence(F.lit(1), "active")))

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        key, k = [pdf[x].iloc[0] for x in keys], int(pdf["k"].iloc[0])
        rows, cols = (np.unique(pdf[x], return_inverse=True)[1] for x in ("bin", "ch"))
        x = np.zeros((rows.max() + 1, cols.max() + 1))
        x[rows, cols] = pdf["n"]  # bins without events add neither to the factors nor to the error
        all_ = bins * x.shape[1]
        left = _nmf_residual(x, min(k, *x.shape), np.random.RandomState(seed_of(seed, k, *key))) ** 2 * x.size
        spread = float((x * x).sum() - x.sum() ** 2 / all_)
        return pd.DataFrame({**{n: [v] for n, v in zip(keys, key)}, "k": [k], "active": [x.shape[1]], "residual": [(left / all_) ** 0.5], "explained": [1 - left / spread if spread > 0 else 0.0]})

    return c.groupBy(*keys, "k").applyInPandas(run, f"{_kinds(counts, keys)}, k int, active int, residual double, explained double")


def nmf_dimensions(counts: DataFrame, bins: int, keys=("rec",), share: float = 0.95, seed: int = 1) -> DataFrame:
    """(keys, active, components, relative, rank): components before the residual reaches that of shuffled counts, the same for each active channel, and
    the least rank that explains more than `share` of the variance (all channels if none does)."""
    keys = list(keys)
    sweep = nmf_variance(counts, bins, keys, seed)
    rank = sweep.groupBy(*keys).agg(F.first("active").alias("active"), F.coalesce(F.min(F.when(F.col("explained") > share, F.col("k"))), F.first("active")).alias("rank"))
    both = rank.join(nmf_components(counts, keys, seed), keys, "left")
    return both.select(*keys, "active", "components", (F.col("components") / F.col("active")).alias("relative"), "rank")
