"""Graph metrics on edge tables (keys, src, dst, w), each network one value of keys; all networks of a batch go in one job.

Relational metrics are joins and groupBys with no limit on a network's size. Searches over whole networks (shortest paths, peeling,
power iteration) are loops of joins whose state is written between rounds. See kernels.py for the sequential ones.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.iterate import cut
from ..functions.scalars import correlation
from .connectivity import both_ways


def degrees(edges: DataFrame, keys: list[str], least: float = 1e-4) -> DataFrame:
    """(keys, node, degree, strength, mean_weight): degree counts weights of at least `least`."""
    s = both_ways(edges, keys)
    return s.groupBy(*keys, F.col("src").alias("node")).agg(F.sum((F.col("w") >= least).cast("long")).alias("degree"), F.sum("w").alias("strength"), F.avg(F.when(F.col("w") > 0, F.col("w"))).alias("mean_weight"))


def density(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    m = edges.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, keys, "left").select(*keys, "n", F.coalesce("m", F.lit(0)).alias("m"), F.when(F.col("n") > 1, F.coalesce("m", F.lit(0)) / (F.col("n") * (F.col("n") - 1) / 2)).alias("density"))


def tail_means(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Mean of values at or above the 75th and 90th percentile, and at or below the 10th."""
    q = rows.groupBy(*keys).agg(*(F.percentile(value, F.lit(p)).alias(f"p{int(p * 100)}") for p in (0.75, 0.9, 0.1)))
    j = rows.join(q, keys)
    v = F.col(value)
    return j.groupBy(*keys).agg(F.avg(v).alias("mean"), F.avg(F.when(v >= F.col("p75"), v)).alias("top25"), F.avg(F.when(v >= F.col("p90"), v)).alias("top10"), F.avg(F.when(v <= F.col("p10"), v)).alias("bottom10"))


def triangles(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y, z, wxy, wyz, wxz) with x < y < z."""
    a = edges.select(*keys, F.col("src").alias("x"), F.col("dst").alias("y"), F.col("w").alias("wxy"))
    b = edges.select(*keys, F.col("src").alias("y"), F.col("dst").alias("z"), F.col("w").alias("wyz"))
    c = edges.select(*keys, F.col("src").alias("x"), F.col("dst").alias("z"), F.col("w").alias("wxz"))
    return a.join(b, [*keys, "y"]).join(c, [*keys, "x", "z"]).select(*keys, "x", "y", "z", "wxy", "wyz", "wxz")


def clustering(edges: DataFrame, keys: list[str], binary: bool = False) -> DataFrame:
    """(keys, node, cc): sum of cube roots of the three weights of triangles at a node over k(k-1)/2; 0 without a triangle."""
    e = edges.withColumn("w", F.lit(1.0)) if binary else edges
    t = triangles(e, keys).withColumn("__v", F.cbrt(F.col("wxy") * F.col("wyz") * F.col("wxz")))
    t = t.select(*keys, F.explode(F.array("x", "y", "z")).alias("node"), "__v").groupBy(*keys, "node").agg(F.sum("__v").alias("__s"))
    d = degrees(edges, keys, 0.0).select(*keys, "node", "degree")
    return d.join(t, [*keys, "node"], "left").select(*keys, "node", F.coalesce(2 * F.col("__s") / (F.col("degree") * (F.col("degree") - 1)), F.lit(0.0)).alias("cc"))


def transitivity(edges: DataFrame, keys: list[str], binary: bool = True) -> DataFrame:
    """Three times the (weighted) triangles over the connected triples of a network."""
    e = edges.withColumn("w", F.lit(1.0)) if binary else edges
    t = triangles(e, keys).groupBy(*keys).agg(F.sum(F.cbrt(F.col("wxy") * F.col("wyz") * F.col("wxz"))).alias("__t"))
    p = degrees(edges, keys, 0.0).groupBy(*keys).agg(F.sum(F.col("degree") * (F.col("degree") - 1)).alias("__p"))
    return p.join(t, keys, "left").select(*keys, F.try_divide(6 * F.coalesce("__t", F.lit(0.0)), F.col("__p")).alias("transitivity"))


def _lengths(edges: DataFrame, keys: list[str]) -> DataFrame:
    return both_ways(edges, keys).filter("src <> dst").select(*keys, "src", "dst", (1 / F.col("w")).alias("d"))


def shortest_paths(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, d) of all reachable ordered pairs, src <> dst, on lengths 1/w."""
    from .kernels import distances

    return distances(_lengths(edges, keys), keys)


def path_sums(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, far, close, reached) of shortest_paths: sums of d and of 1 / d and the number of nodes reached, without a row for each pair."""
    from .kernels import distance_sums

    return distance_sums(_lengths(edges, keys), keys)


def _summed(paths: DataFrame, keys: list[str]) -> DataFrame:
    return paths if "reached" in paths.columns else paths.groupBy(*keys, "src").agg(F.sum("d").alias("far"), F.sum(1 / F.col("d")).alias("close"), F.count(F.lit(1)).alias("reached"))


def path_metrics(paths: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """Characteristic path length (mean of finite distances) and global efficiency (unreachable pairs count 0), from pairs or their sums."""
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    a = _summed(paths, keys).groupBy(*keys).agg(F.try_divide(F.sum("far"), F.sum("reached")).alias("path_length"), F.sum("close").alias("__e"))
    return n.join(a, keys, "left").select(*keys, "path_length", (F.coalesce("__e", F.lit(0.0)) / (F.col("n") * F.col("n") - F.col("n"))).alias("global_efficiency"))


def nodal_efficiency(paths: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, ne): 1 over the mean distance with the own 0 included; 0 for a node that does not reach all others. From pairs or their sums."""
    n = nodes.withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    a = _summed(paths, keys).select(*keys, F.col("src").alias("node"), F.col("far").alias("__s"), F.col("reached").alias("__k"))
    return n.join(a, [*keys, "node"], "left").select(*keys, "node", F.when(F.col("__k") == F.col("n") - 1, F.col("n") / F.col("__s")).otherwise(0.0).alias("ne"))


def local_efficiency(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, eloc): efficiency of each node's neighbourhood, distances on cube roots of lengths, weighted by cube roots of the node's weights."""
    top = F.max("w").over(Window.partitionBy(*keys))
    s = both_ways(edges.withColumn("w", F.col("w") / top), keys)
    ego = s.select(*keys, F.col("src").alias("node"), F.col("dst").alias("src"))
    inner = ego.join(edges.withColumn("w", F.cbrt(F.col("w") / top)), [*keys, "src"]).join(ego.withColumnRenamed("src", "dst"), [*keys, "node", "dst"]).select(*keys, "node", "src", "dst", "w")
    d = shortest_paths(inner, [*keys, "node"])
    wt = s.select(*keys, F.col("src").alias("node"), F.col("dst").alias("o"), F.cbrt("w").alias("__w"))
    num = d.join(wt.select(*keys, "node", F.col("o").alias("src"), F.col("__w").alias("wi")), [*keys, "node", "src"]).join(wt.select(*keys, "node", F.col("o").alias("dst"), F.col("__w").alias("wj")), [*keys, "node", "dst"])
    num = num.groupBy(*keys, "node").agg(F.sum(4 * F.col("wi") * F.col("wj") / F.col("d")).alias("num"))
    k = s.groupBy(*keys, F.col("src").alias("node")).agg(F.count(F.lit(1)).alias("k"))
    den = 4 * F.col("k") * F.col("k") - 4 * F.col("k")
    return k.join(num, [*keys, "node"], "left").select(*keys, "node", F.coalesce(F.col("num") / den, F.lit(0.0)).alias("eloc"))


def participation(edges: DataFrame, communities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, pc): 1 - sum of squared shares of strength by community."""
    s = both_ways(edges, keys).join(communities.select(*keys, F.col("node").alias("dst"), "community"), [*keys, "dst"])
    m = s.groupBy(*keys, "src", "community").agg(F.sum("w").alias("k"))
    return m.groupBy(*keys, F.col("src").alias("node")).agg((1 - F.sum(F.col("k") * F.col("k")) / (F.sum("k") * F.sum("k"))).alias("pc"))


def module_zscore(edges: DataFrame, communities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, z): z-score (sample deviation) of the strength inside the own community; 0 where undefined."""
    c = communities.select(*keys, "node", "community")
    s = both_ways(edges, keys).join(c.select(*keys, F.col("node").alias("src"), F.col("community").alias("ca")), [*keys, "src"]).join(c.select(*keys, F.col("node").alias("dst"), F.col("community").alias("cb")), [*keys, "dst"]).filter("ca = cb")
    k = c.join(s.groupBy(*keys, F.col("src").alias("node")).agg(F.sum("w").alias("k")), [*keys, "node"], "left").withColumn("k", F.coalesce("k", F.lit(0.0)))
    w = Window.partitionBy(*keys, "community")
    sd = F.stddev_samp("k").over(w)
    return k.select(*keys, "node", F.when(sd > 0, (F.col("k") - F.avg("k").over(w)) / sd).otherwise(0.0).alias("z"))


def modularity(edges: DataFrame, communities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, q) of a partition."""
    c = communities.select(*keys, "node", "community")
    s = both_ways(edges, keys)
    k = s.groupBy(*keys, F.col("src").alias("node")).agg(F.sum("w").alias("k"))
    total = k.groupBy(*keys).agg(F.sum("k").alias("s"))
    inside = s.join(c.select(*keys, F.col("node").alias("src"), F.col("community").alias("ca")), [*keys, "src"]).join(c.select(*keys, F.col("node").alias("dst"), F.col("community").alias("cb")), [*keys, "dst"]).filter("ca = cb").groupBy(*keys).agg(F.sum("w").alias("i"))
    by = c.join(k, [*keys, "node"]).groupBy(*keys, "community").agg(F.sum("k").alias("kc")).groupBy(*keys).agg(F.sum(F.col("kc") * F.col("kc")).alias("sq"))
    return total.join(by, keys).join(inside, keys, "left").select(*keys, (F.coalesce("i", F.lit(0.0)) / F.col("s") - F.col("sq") / (F.col("s") * F.col("s"))).alias("q"))


def rich_club(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, k, rw), k from 1 to the largest level with an edge: weight among nodes of degree >= k over the sum of as many strongest entries of the network."""
    d = degrees(edges, keys, 0.0).select(*keys, "node", "degree")
    e = edges.join(d.select(*keys, F.col("node").alias("src"), F.col("degree").alias("ds")), [*keys, "src"]).join(d.select(*keys, F.col("node").alias("dst"), F.col("degree").alias("dd")), [*keys, "dst"])
    level = e.groupBy(*keys, F.least("ds", "dd").cast("int").alias("top_k")).agg(F.sum("w").alias("wr"), F.count(F.lit(1)).cast("int").alias("er"))
    club = level.withColumn("k", F.explode(F.sequence(F.lit(1), "top_k"))).groupBy(*keys, "k").agg(F.sum("wr").alias("wr"), F.sum("er").alias("er"))
    w = Window.partitionBy(*keys).orderBy(F.desc("w"), "src", "dst")
    ranked = edges.select(*keys, F.row_number().over(w).alias("er"), F.sum("w").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("top"))
    return club.join(ranked, [*keys, "er"]).select(*keys, "k", F.try_divide(F.col("wr"), F.col("top")).alias("rw"))


#: Default boundaries of node roles.
ROLE_CUTS = {"hub_z": 2.5, "peripheral": 0.625, "connector": 0.8, "provincial_hub": 0.30, "connector_hub": 0.75}


def roles(nodes: DataFrame, cuts: dict[str, float] = ROLE_CUTS) -> DataFrame:
    """nodes (pc, z) with role 1 to 6: peripheral, non-hub connector, non-hub kinless, provincial hub, connector hub, kinless hub."""
    pc, hub = F.col("pc"), F.col("z") > cuts["hub_z"]
    role = (
        F.when(~hub & (pc <= cuts["peripheral"]), 1).when(~hub & (pc <= cuts["connector"]), 2).when(~hub, 3)
        .when(pc <= cuts["provincial_hub"], 4).when(pc <= cuts["connector_hub"], 5).otherwise(6)
    )
    return nodes.withColumn("role", role)


def hubs(nodes: DataFrame, keys: list[str], metrics: list[str], at_least: int = 3) -> DataFrame:
    """(keys, hub_share): share of nodes in the top tenth (ties included) of at least `at_least` of the metrics."""
    n = Window.partitionBy(*keys)
    rows = nodes
    for m in metrics:
        rn = F.row_number().over(n.orderBy(F.desc(m), "node"))
        k = F.floor(F.count(F.lit(1)).over(n) * 0.1 + 0.5)
        rows = rows.withColumn("__r", F.when(rn == k, F.col(m))).withColumn(f"__top_{m}", F.coalesce((F.col(m) >= F.max("__r").over(n)).cast("int"), F.lit(0))).drop("__r")
    score = sum((F.col(f"__top_{m}") for m in metrics[1:]), F.col(f"__top_{metrics[0]}"))
    return rows.withColumn("__s", score).groupBy(*keys).agg(F.avg((F.col("__s") >= at_least).cast("double")).alias("hub_share"))


def induced(edges: DataFrame, membership: DataFrame, keys: list[str]) -> DataFrame:
    """Edges inside each group of a many-to-many membership (rec, ch, cell_group): keys, cell_group, src, dst, w."""
    m = membership.select("rec", "ch", "cell_group")
    a = edges.join(m.withColumnRenamed("ch", "src"), ["rec", "src"])
    return a.join(m.withColumnRenamed("ch", "dst"), ["rec", "dst", "cell_group"]).select(*keys, "cell_group", "src", "dst", "w")


def edge_mixing(edges: DataFrame, membership: DataFrame, keys: list[str]) -> DataFrame:
    """Edges between groups: keys, group_a <= group_b, n_edges, mean_weight; n_possible counts ordered node pairs once."""
    m = membership.select("rec", "ch", "cell_group")
    a, b = m.select("rec", F.col("ch").alias("x"), F.col("cell_group").alias("group_a")), m.select("rec", F.col("ch").alias("y"), F.col("cell_group").alias("group_b"))
    same = (F.col("group_a") < F.col("group_b")) | ((F.col("group_a") == F.col("group_b")) & (F.col("x") < F.col("y")))
    e = both_ways(edges, keys).select(*keys, F.col("src").alias("x"), F.col("dst").alias("y"), "w")
    found = e.join(a, ["rec", "x"]).join(b, ["rec", "y"]).filter(same).groupBy(*keys, "group_a", "group_b").agg(F.count(F.lit(1)).alias("n_edges"), F.avg("w").alias("mean_weight"))
    sizes = m.groupBy("rec", "cell_group").agg(F.count(F.lit(1)).alias("n"))
    both = m.select("rec", "ch", F.col("cell_group").alias("group_a")).join(m.select("rec", "ch", F.col("cell_group").alias("group_b")), ["rec", "ch"]).filter("group_a < group_b").groupBy("rec", "group_a", "group_b").agg(F.count(F.lit(1)).alias("shared"))
    pa = sizes.select("rec", F.col("cell_group").alias("group_a"), F.col("n").alias("na"))
    pb = sizes.select("rec", F.col("cell_group").alias("group_b"), F.col("n").alias("nb"))
    possible = pa.join(pb, "rec").filter("group_a <= group_b").join(both, ["rec", "group_a", "group_b"], "left")
    possible = possible.select("rec", "group_a", "group_b", F.when(F.col("group_a") == F.col("group_b"), F.col("na") * (F.col("na") - 1) / 2).otherwise(F.col("na") * F.col("nb") - F.coalesce("shared", F.lit(0))).cast("long").alias("n_possible"))
    return possible.join(found, ["rec", "group_a", "group_b"], "left").withColumn("n_edges", F.coalesce("n_edges", F.lit(0)))


def within_group_strength(edges: DataFrame, membership: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, cell_group, node, share): share of a node's strength that stays in the group."""
    total = degrees(edges, keys, 0.0).select(*keys, "node", "strength")
    m = membership.select("rec", F.col("ch").alias("node"), "cell_group")
    inside = degrees(induced(edges, membership, keys), [*keys, "cell_group"], 0.0).select(*keys, "cell_group", "node", F.col("strength").alias("inside"))
    return total.join(m, ["rec", "node"]).join(inside, [*keys, "cell_group", "node"], "left").select(*keys, "cell_group", "node", F.try_divide(F.coalesce("inside", F.lit(0.0)), F.col("strength")).alias("share"))


def _stars(edges: DataFrame, keys: list[str], most: int = 1 << 22) -> DataFrame:
    """Edges (keys, src, dst) with the same components, far fewer where networks are dense: each task joins the nodes that its edges connect to the
    least of them. A network's edges lie in one task, or by src in as many as hold `most` edges each."""
    import numpy as np
    import pandas as pd

    kind = ", ".join(f"{c} {edges.schema[c].dataType.simpleString()}" for c in (*keys, "src", "dst"))
    large = edges.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / most).alias("__parts")).filter("__parts > 1")  # few: each has over `most` edges
    dealt = edges.select(*keys, "src", "dst").join(F.broadcast(large), keys, "left").withColumn("__part", F.pmod(F.xxhash64("src"), F.coalesce("__parts", F.lit(1)))).repartition(*keys, "__part")

    def joined(pdf: pd.DataFrame) -> pd.DataFrame:
        m = len(pdf)
        codes = np.zeros(m, np.int64)
        for k in keys:
            codes = pd.factorize(codes * (m + 1) + pd.factorize(pdf[k], use_na_sentinel=False)[0])[0].astype(np.int64)
        nodes, ends = np.unique(np.concatenate([pdf["src"].to_numpy(), pdf["dst"].to_numpy()]), return_inverse=True)
        own, at = np.unique(np.concatenate([codes, codes]) * len(nodes) + ends, return_inverse=True)
        a, b, label = at[:m], at[m:], np.arange(len(own))
        while True:  # labels are numbered by network and node, so that the least label is the least node
            low = np.minimum(label[a], label[b])
            if (low == label[a]).all() and (low == label[b]).all():
                break
            for end in (a, b):
                np.minimum.at(label, label[end], low)
                np.minimum.at(label, end, low)
            while (label[label] != label).any():
                label = label[label]
        row = np.empty(len(own), np.int64)
        row[a] = row[b] = np.arange(m)
        leaf = label != np.arange(len(own))
        out = pdf.iloc[row[leaf]][list(keys)].reset_index(drop=True)
        out["src"], out["dst"] = nodes[own[leaf] % len(nodes)], nodes[own[label[leaf]] % len(nodes)]
        alone = (pdf["src"] == pdf["dst"]).to_numpy()
        return pd.concat([out, pdf.loc[alone, [*keys, "src", "dst"]]]) if alone.any() else out

    def run(frames):
        held, n = [], 0
        for pdf in frames:
            held.append(pdf)
            n += len(pdf)
            if n >= most:
                yield joined(pd.concat(held, ignore_index=True))
                held, n = [], 0
        if n:
            yield joined(pd.concat(held, ignore_index=True))

    return dealt.select(*keys, "src", "dst").mapInPandas(run, kind)


def components(edges: DataFrame, keys: list[str], max_rounds: int = 64) -> DataFrame:
    """(keys, node, component): least node reachable, by label spreading with shortcuts, once edges within a task are joined."""
    s = both_ways(cut(_stars(edges, keys)).withColumn("w", F.lit(1.0)), keys)
    now = cut(s.groupBy(*keys, F.col("src").alias("node")).agg(F.least(F.min("dst"), F.first("src")).alias("component")))
    for _ in range(max_rounds):
        near = s.join(now.select(*keys, F.col("node").alias("dst"), "component"), [*keys, "dst"]).groupBy(*keys, F.col("src").alias("node")).agg(F.min("component").alias("m"))
        nxt = now.join(near, [*keys, "node"]).select(*keys, "node", F.least("component", "m").alias("component"), F.col("component").alias("old"))
        jump = nxt.select(*keys, F.col("node").alias("component"), F.col("component").alias("to"))
        nxt = cut(nxt.join(jump, [*keys, "component"]).select(*keys, "node", F.least("component", "to").alias("component"), (F.least("component", "to") < F.col("old")).alias("moved")))
        now = nxt.drop("moved")
        if nxt.filter("moved").isEmpty():
            return now
    raise RuntimeError("components did not settle")


def k_core(edges: DataFrame, keys: list[str], k: int) -> DataFrame:
    """Edges left when nodes of degree below k are peeled until none is left. Of arcs, the degree is in-degree plus out-degree."""
    now = cut(edges.select(*keys, "src", "dst", "w"))
    while True:
        low = both_ways(now, keys).groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("d")).filter(F.col("d") < k).select(*keys, F.col("src").alias("node"))
        if low.isEmpty():
            return now
        now = cut(now.join(low.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti").join(low.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_anti").select(*keys, "src", "dst", "w"))


def s_core(edges: DataFrame, keys: list[str], s: float) -> DataFrame:
    """As k_core with strength below s."""
    now = cut(edges.select(*keys, "src", "dst", "w"))
    while True:
        low = both_ways(now, keys).groupBy(*keys, "src").agg(F.sum("w").alias("d")).filter(F.col("d") < s).select(*keys, F.col("src").alias("node"))
        if low.isEmpty():
            return now
        now = cut(now.join(low.withColumnRenamed("node", "src"), [*keys, "src"], "left_anti").join(low.withColumnRenamed("node", "dst"), [*keys, "dst"], "left_anti").select(*keys, "src", "dst", "w"))


def coreness(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, coreness): the largest k whose core keeps the node."""
    out, k = both_ways(edges, keys).select(*keys, F.col("src").alias("node")).distinct().withColumn("coreness", F.lit(1)), 2
    now = edges
    while not (now := k_core(now, keys, k)).isEmpty():
        out = out.unionByName(both_ways(now, keys).select(*keys, F.col("src").alias("node")).distinct().withColumn("coreness", F.lit(k)))
        k += 1
    return out.groupBy(*keys, "node").agg(F.max("coreness").alias("coreness"))


def pagerank(edges: DataFrame, keys: list[str], damping: float = 0.85, tolerance: float = 1e-9, max_rounds: int = 160) -> DataFrame:
    """(keys, node, rank), summing to 1 in each network."""
    s = both_ways(edges, keys)
    out = s.withColumn("share", F.col("w") / F.sum("w").over(Window.partitionBy(*keys, "src")))
    nodes = s.select(*keys, F.col("src").alias("node")).distinct().withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*keys)))
    out, now = cut(out), cut(nodes.withColumn("rank", 1 / F.col("n")))
    for i in range(max_rounds):
        got = out.join(now.select(*keys, F.col("node").alias("src"), "rank"), [*keys, "src"]).groupBy(*keys, F.col("dst").alias("node")).agg(F.sum(F.col("rank") * F.col("share")).alias("g"))
        nxt = now.join(got, [*keys, "node"], "left").select(*keys, "node", "n", ((1 - damping) / F.col("n") + damping * F.coalesce("g", F.lit(0.0))).alias("rank"), F.col("rank").alias("old"))
        if i % 8 == 7:
            nxt = cut(nxt)
            if (nxt.agg(F.max(F.abs(F.col("rank") - F.col("old")))).first()[0] or 0) < tolerance:
                return nxt.select(*keys, "node", "rank")
        now = nxt.drop("old")
    raise RuntimeError("ranks did not settle")


def assortativity(edges: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    """Correlation of the degrees (or strengths) at the two ends of edges."""
    d = degrees(edges, keys, 0.0).select(*keys, "node", (F.col("strength") if weighted else F.col("degree").cast("double")).alias("d"))
    s = both_ways(edges, keys).join(d.select(*keys, F.col("node").alias("src"), F.col("d").alias("x")), [*keys, "src"]).join(d.select(*keys, F.col("node").alias("dst"), F.col("d").alias("y")), [*keys, "dst"])
    return s.groupBy(*keys).agg(correlation("x", "y").alias("r"))


def _common(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, da, db, c, a), src < dst, of pairs that share a neighbour or an edge: degrees, common neighbours, edge (1 or 0)."""
    from .meetings import common

    return common(edges, keys)


def matching_index(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, m): twice the common neighbours over all connections of both ends but their own edge; pairs that share one."""
    return _common(edges, keys).filter("c > 0").select(*keys, "src", "dst", (2 * F.col("c") / (F.col("da") + F.col("db") - 2 * F.col("a"))).alias("m"))


def topological_overlap(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, o) = (common + a) / (min degree + 1 - a) over pairs with a common neighbour or an edge."""
    return _common(edges, keys).select(*keys, "src", "dst", ((F.col("c") + F.col("a")) / (F.least("da", "db") + 1 - F.col("a"))).alias("o"))


def neighbour_overlap(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, o) per edge: Jaccard of the ends' other neighbours."""
    from .meetings import common_of_edges

    union = F.col("da") + F.col("db") - 2 - F.col("c")
    return common_of_edges(edges, keys).select(*keys, "src", "dst", F.when(union > 0, F.col("c") / union).otherwise(0.0).alias("o"))


def directed_degrees(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, indegree, outdegree, in_strength, out_strength) of a directed edge table."""
    o = arcs.select(*keys, F.col("src").alias("node"), F.lit(0).alias("i"), F.lit(1).alias("o"), F.lit(0.0).alias("wi"), F.col("w").alias("wo"))
    i = arcs.select(*keys, F.col("dst").alias("node"), F.lit(1).alias("i"), F.lit(0).alias("o"), F.col("w").alias("wi"), F.lit(0.0).alias("wo"))
    return o.unionByName(i).groupBy(*keys, "node").agg(F.sum("i").alias("indegree"), F.sum("o").alias("outdegree"), F.sum("wi").alias("in_strength"), F.sum("wo").alias("out_strength"))


def joint_degrees(arcs: DataFrame, keys: list[str]) -> DataFrame:
    return directed_degrees(arcs, keys).groupBy(*keys, "indegree", "outdegree").agg(F.count(F.lit(1)).alias("nodes"))


def walks(edges: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, q, n) number of walks of length q = 1..length."""
    s = both_ways(edges, keys).select(*keys, "src", "dst")
    now = s.groupBy(*keys, "src", "dst").agg(F.lit(1).cast("long").alias("n"))
    out = now.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("q", F.lit(1))
    step = s.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("__to"))
    for q in range(2, length + 1):
        now = cut(now.join(step, [*keys, "dst"]).groupBy(*keys, "src", F.col("__to").alias("dst")).agg(F.sum("n").alias("n")))
        out = out.unionByName(now.groupBy(*keys).agg(F.sum("n").alias("n")).withColumn("q", F.lit(q)))
    return out


def agreement(partitions: DataFrame, keys: list[str], run: str = "run", weights: DataFrame | None = None, digits: int | None = None, chunk: int = 4000) -> DataFrame:
    """(keys, src, dst, n): runs that put a pair into one community; with weights (keys, run, weight), the share of weight of these runs.

    Nodes of the same communities in all runs are one kind; n is found for pairs of kinds, and the pairs of nodes are listed from chunks of
    at most about `chunk` nodes, so that none of them is shuffled, kept or aggregated. digits: round n, once for each pair of kinds.
    """
    known = " and ".join(f"{c} is not null" for c in (*keys, "node", run, "community"))
    marks = partitions.filter(known).groupBy(*keys, "node", run, "community").agg(F.count(F.lit(1)).alias("__c"))
    nodes = cut(marks.groupBy(*keys, "node").agg(F.sort_array(F.collect_list(F.struct(run, "community", "__c"))).alias("__marks")))  # read twice
    kinds = nodes.groupBy(*keys, "__marks").agg(F.min("node").alias("__kind"), F.ceil(F.count(F.lit(1)) / chunk).alias("__parts"))
    dealt = nodes.join(kinds, [*keys, "__marks"]).select(*keys, "node", "__kind", F.pmod(F.xxhash64("node"), F.col("__parts")).alias("__part"))
    chunks = dealt.groupBy(*keys, "__kind", "__part").agg(F.collect_list("node").alias("__nodes"))
    a, b = (kinds.select(*keys, F.col("__kind").alias(f"__kind_{x}"), F.inline("__marks").alias(run, "community", f"__c_{x}")) for x in "ab")
    together, times = a.join(b, [*keys, run, "community"]).filter("__kind_a <= __kind_b"), F.col("__c_a") * F.col("__c_b")
    if weights is None:
        n = F.sum(times)
    else:
        share = weights.join(weights.groupBy(*keys).agg(F.sum("weight").alias("__all")), keys).select(*keys, run, F.try_divide("weight", "__all").alias("__share"))
        together, n = together.join(share, [*keys, run]), F.sum(F.col("__share") * times)
    pairs = together.groupBy(*keys, "__kind_a", "__kind_b").agg((n if digits is None else F.round(n, digits)).alias("n"))
    for x in "ab":
        pairs = pairs.join(chunks.select(*keys, F.col("__kind").alias(f"__kind_{x}"), F.col("__part").alias(f"__part_{x}"), F.col("__nodes").alias(f"__{x}")), [*keys, f"__kind_{x}"])
    same = (F.col("__kind_a") == F.col("__kind_b")) & (F.col("__part_a") == F.col("__part_b"))
    tasks = 8 * int(partitions.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    pairs = pairs.filter("__kind_a < __kind_b or __part_a <= __part_b").repartition(tasks, *keys, "__kind_a", "__part_a", "__kind_b", "__part_b")
    pairs = pairs.select(*keys, "n", same.alias("__same"), "__b", F.explode("__a").alias("__x")).select(*keys, "n", "__same", "__x", F.explode("__b").alias("__y"))
    return pairs.filter("not __same or __x < __y").select(*keys, F.least("__x", "__y").alias("src"), F.greatest("__x", "__y").alias("dst"), "n")


def partition_distance(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, vi, mi): normalised variation of information and mutual information of two partitions of the same nodes."""
    j = a.select(*keys, "node", F.col("community").alias("x")).join(b.select(*keys, "node", F.col("community").alias("y")), [*keys, "node"])
    n = j.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    h = lambda by: j.groupBy(*keys, *by).agg(F.count(F.lit(1)).alias("c")).join(n, keys).groupBy(*keys).agg((-F.sum(F.col("c") / F.col("n") * F.ln(F.col("c") / F.col("n")))).alias("h_" + "".join(by)))
    out = n.join(h(["x"]), keys).join(h(["y"]), keys).join(h(["x", "y"]), keys)
    s = F.col("h_x") + F.col("h_y")
    return out.select(*keys, F.when(F.col("n") > 1, (2 * F.col("h_xy") - s) / F.ln("n")).alias("vi"), F.when(s > 0, 2 * (s - F.col("h_xy")) / s).alias("mi"))


def motifs3(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, motif, n): connected three-node patterns of a directed graph, each set of nodes once. motif is the least six-bit code of the
    pattern over the orders of its nodes, bits ab ba ac ca bc cb."""
    one = arcs.select(*keys, "src", "dst").distinct().withColumn("w", F.lit(1.0))
    return weighted_motifs3(one, keys).groupBy(*keys, "motif").agg((F.sum("n") / 3).cast("long").alias("n"))


def _triples(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, a, b, c), a < b < c, of every three nodes that are all joined in pairs (keys, u, v), u < v.

    Pairs point to the end of more neighbours, so that no node points to more than the root of twice the pairs. A node sends each one that it
    points to those that come after it; the one meets them with its own.
    """
    size = pairs.select(*keys, F.explode(F.array("u", "v")).alias("u")).groupBy(*keys, "u").agg(F.count(F.lit(1)).alias("du"))
    p = pairs.select(*keys, "u", "v").join(size, [*keys, "u"]).join(size.withColumnsRenamed({"u": "v", "du": "dv"}), [*keys, "v"])
    low, high = F.struct(F.col("du").alias("d"), F.col("u").alias("x")), F.struct(F.col("dv").alias("d"), F.col("v").alias("x"))
    p = p.select(*keys, F.least(low, high).alias("p"), F.greatest(low, high).alias("q"))
    lists = p.groupBy(*keys, F.col("p.x").alias("p")).agg(F.sort_array(F.collect_list("q"))["x"].alias("qs"))
    sent = lists.select(*keys, "p", "qs", F.posexplode("qs").alias("i", "q")).filter(F.col("i") + 1 < F.size("qs"))
    sent = sent.select(*keys, "p", "q", F.slice("qs", F.col("i") + 2, F.size("qs")).alias("rest"))
    met = sent.join(lists.select(*keys, F.col("p").alias("q"), "qs"), [*keys, "q"]).select(*keys, "p", "q", F.explode(F.array_intersect("rest", "qs")).alias("r"))
    return met.select(*keys, F.sort_array(F.array("p", "q", "r")).alias("s")).select(*keys, F.col("s")[0].alias("a"), F.col("s")[1].alias("b"), F.col("s")[2].alias("c"))


#: The six arcs of three nodes a, b, c in the order of a pattern's bits, highest first.
_ARCS = (("a", "b"), ("b", "a"), ("a", "c"), ("c", "a"), ("b", "c"), ("c", "b"))


def _pattern_classes() -> dict[int, int]:
    """Of every six-bit pattern that connects its three nodes: the least code over the orders of the nodes."""
    from itertools import permutations

    out = {}
    for code in range(64):
        arcs = {arc for k, arc in enumerate(_ARCS) if code >> (5 - k) & 1}
        if len({frozenset(arc) for arc in arcs}) >= 2:
            names = [dict(zip("abc", order)) for order in permutations("abc")]
            out[code] = min(sum(1 << (5 - _ARCS.index((m[x], m[y]))) for x, y in arcs) for m in names)
    return out


def weighted_motifs3(arcs: DataFrame, keys: list[str], functional: bool = False) -> DataFrame:
    """(keys, node, motif, n, intensity, coherence) of the connected three-node patterns of a directed graph with positive weights w.

    Structural: each three nodes count once, with the pattern of all their arcs; functional: once with every connected pattern among their arcs.
    A pattern's intensity is the geometric mean of its arcs' weights and its coherence that over their arithmetic mean; both are added up,
    with the count n, at each of its three nodes. motif as in motifs3. Loops go, arcs that repeat are added up.

    Patterns of two linked pairs are summed at the node that these share, over classes of neighbours with equal weights, and sent back to the
    neighbours: no three nodes are listed for them. Only three nodes that are all linked are listed; structural ones take back there what
    they counted as two linked pairs.
    """
    w = arcs.filter("src <> dst and w > 0").groupBy(*keys, "src", "dst").agg(F.sum("w").alias("w"))
    pairs = w.select(*keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), F.when(F.col("src") < F.col("dst"), F.col("w")).alias("up"), F.when(F.col("src") > F.col("dst"), F.col("w")).alias("down"))
    pairs = cut(pairs.groupBy(*keys, "u", "v").agg(F.coalesce(F.sum("up"), F.lit(0.0)).alias("up"), F.coalesce(F.sum("down"), F.lit(0.0)).alias("down")))
    classes = _pattern_classes()
    within = lambda codes: F.filter(F.array(*map(F.lit, codes)), lambda m: m.bitwiseAND(F.col("full")) == m)
    weight = [F.col(f"w_{x}{y}") for x, y in _ARCS]
    full = sum((F.when(c > 0, 1 << (5 - k)).otherwise(0) for k, c in enumerate(weight)), F.lit(0))
    used = [F.col("code").bitwiseAND(1 << (5 - k)) > 0 for k in range(6)]
    size = F.bit_count("code")
    logs = sum((F.when(u, F.ln(c)).otherwise(0.0) for u, c in zip(used, weight)), F.lit(0.0))
    mean = sum((F.when(u, c).otherwise(0.0) for u, c in zip(used, weight)), F.lit(0.0)) / size
    motif = F.create_map(*(F.lit(x) for pair in classes.items() for x in pair))[F.col("code")]
    values = (motif.alias("motif"), F.exp(logs / size).alias("i"), (F.exp(logs / size) / mean).alias("h"))
    # two linked pairs: node x, and classes of its neighbours by the weights to and from them
    links = pairs.select(*keys, F.col("u").alias("x"), F.col("v").alias("y"), F.col("up").alias("w_ab"), F.col("down").alias("w_ba")).unionByName(pairs.select(*keys, F.col("v").alias("x"), F.col("u").alias("y"), F.col("down").alias("w_ab"), F.col("up").alias("w_ba")))
    kinds = links.groupBy(*keys, "x", "w_ab", "w_ba").agg(F.count(F.lit(1)).alias("size"))
    other = kinds.select(*keys, "x", F.col("w_ab").alias("w_ac"), F.col("w_ba").alias("w_ca"), F.col("size").alias("m"))
    same = (F.col("w_ab") == F.col("w_ac")) & (F.col("w_ba") == F.col("w_ca"))
    two = kinds.join(other, [*keys, "x"]).withColumn("m", F.col("m") - same.cast("long")).filter("m > 0")
    two = two.withColumns({"w_bc": F.lit(0.0), "w_cb": F.lit(0.0)}).withColumn("full", full)
    two = two.withColumn("code", F.explode(within(classes))) if functional else two.withColumn("code", F.col("full"))
    two = two.select(*keys, "x", "w_ab", "w_ba", "size", "m", *values).groupBy(*keys, "x", "w_ab", "w_ba", "size", "motif").agg(F.sum("m").alias("n"), F.sum(F.col("m") * F.col("i")).alias("i"), F.sum(F.col("m") * F.col("h")).alias("h"))
    middle = two.groupBy(*keys, F.col("x").alias("node"), "motif").agg((F.sum(F.col("size") * F.col("n")) / 2).cast("long").alias("n"), *((F.sum(F.col("size") * F.col(c)) / 2).alias(c) for c in "ih"))
    ends = links.join(two.drop("size"), [*keys, "x", "w_ab", "w_ba"]).select(*keys, F.col("y").alias("node"), "motif", "n", "i", "h")
    # three linked pairs
    t = _triples(pairs, keys)
    for x, y in (("a", "b"), ("a", "c"), ("b", "c")):
        t = t.join(pairs.select(*keys, F.col("u").alias(x), F.col("v").alias(y), F.col("up").alias(f"w_{x}{y}"), F.col("down").alias(f"w_{y}{x}")), [*keys, x, y])
    t = t.withColumn("full", full)
    if functional:
        codes = F.transform(within([m for m in classes if all(m & p for p in (48, 12, 3))]), lambda m: F.struct(m.alias("code"), F.lit(1).cast("long").alias("sign")))
    else:
        one = lambda mask, sign: F.struct(F.col("full").bitwiseAND(mask).alias("code"), F.lit(sign).cast("long").alias("sign"))
        codes = F.array(one(63, 1), one(60, -1), one(51, -1), one(15, -1))
    three = t.select("*", F.inline(codes)).select(*keys, "sign", F.explode(F.array("a", "b", "c")).alias("node"), *values)
    three = three.select(*keys, "node", "motif", F.col("sign").alias("n"), *((F.col("sign") * F.col(c)).alias(c) for c in "ih"))
    out = middle.select(*keys, "node", "motif", "n", "i", "h").unionByName(ends).unionByName(three)
    return out.groupBy(*keys, "node", "motif").agg(F.sum("n").alias("n"), F.sum("i").alias("intensity"), F.sum("h").alias("coherence")).filter("n > 0")
