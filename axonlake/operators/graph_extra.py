"""Directed, signed and binary variants of the network metrics, similarity of ends, flows, backbones and node scores.

Edge tables as in network.py; directed ones are called arcs (keys, src, dst, w), one row per direction.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.iterate import cut
from .connectivity import both_ways
from .network import degrees


def signed_strengths(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, positive, negative, total_positive, total_negative): sums of weights by sign, negative ones as magnitudes."""
    s = both_ways(edges, keys)
    a = s.groupBy(*keys, F.col("src").alias("node")).agg(F.sum(F.when(F.col("w") > 0, F.col("w")).otherwise(0.0)).alias("positive"), F.sum(F.when(F.col("w") < 0, -F.col("w")).otherwise(0.0)).alias("negative"))
    w = Window.partitionBy(*keys)
    return a.withColumns({"total_positive": F.sum("positive").over(w), "total_negative": F.sum("negative").over(w)})


def directed_density(arcs: DataFrame, keys: list[str]) -> DataFrame:
    ends = arcs.select(*keys, F.col("src").alias("node")).unionByName(arcs.select(*keys, F.col("dst").alias("node"))).distinct()
    n = ends.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    m = arcs.groupBy(*keys).agg(F.count(F.lit(1)).alias("m"))
    return n.join(m, keys).select(*keys, F.try_divide(F.col("m"), F.col("n") * F.col("n") - F.col("n")).alias("density"))


def _links(arcs: DataFrame, keys: list[str], weighted: bool) -> DataFrame:
    """Both directions of every linked pair with s = sum of (cube roots of) the weights of its arcs, and whether both arcs exist."""
    v = F.cbrt("w") if weighted else F.lit(1.0)
    a = arcs.filter("src <> dst").select(*keys, F.least("src", "dst").alias("u"), F.greatest("src", "dst").alias("v"), v.alias("s")).groupBy(*keys, "u", "v").agg(F.sum("s").alias("s"), F.count(F.lit(1)).alias("k"))
    return a.select(*keys, F.col("u").alias("x"), F.col("v").alias("y"), "s", "k").unionByName(a.select(*keys, F.col("v").alias("x"), F.col("u").alias("y"), "s", "k"))


def directed_clustering(arcs: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    """(keys, node, cycles, possible, cc): closed triples at a node over K(K-1) - 2 * reciprocal neighbours, K = in- plus out-degree."""
    from .meetings import triangle_sums

    e = cut(_links(arcs, keys, weighted))  # read twice
    t = triangle_sums(e, keys).select(*keys, "x", (F.col("sum") / 2).alias("cycles"))
    k = e.groupBy(*keys, "x").agg(F.sum("k").alias("k"), F.sum((F.col("k") == 2).cast("long")).alias("r"))
    j = k.join(t, [*keys, "x"], "left").select(*keys, F.col("x").alias("node"), F.coalesce("cycles", F.lit(0.0)).alias("cycles"), (F.col("k") * (F.col("k") - 1) - 2 * F.col("r")).alias("possible"))
    return j.withColumn("cc", F.when(F.col("cycles") == 0, 0.0).otherwise(F.try_divide(F.col("cycles"), F.col("possible"))))


def directed_transitivity(arcs: DataFrame, keys: list[str], weighted: bool = False) -> DataFrame:
    return directed_clustering(arcs, keys, weighted).groupBy(*keys).agg(F.try_divide(F.sum("cycles"), F.sum("possible")).alias("transitivity"))


def signed_clustering(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, positive, negative): weighted clustering by cube roots within the positive and within the negative edges."""
    from .network import clustering

    p = clustering(edges.filter("w > 0"), keys).withColumnRenamed("cc", "positive")
    n = clustering(edges.filter("w < 0").withColumn("w", -F.col("w")), keys).withColumnRenamed("cc", "negative")
    return p.join(n, [*keys, "node"], "full").select(*keys, "node", F.coalesce("positive", F.lit(0.0)).alias("positive"), F.coalesce("negative", F.lit(0.0)).alias("negative"))


def hops(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, d): least number of arcs from src to dst <> src."""
    from .kernels import arc_counts

    return arc_counts(arcs.select(*keys, "src", "dst").filter("src <> dst"), keys)


def binary_efficiency(edges: DataFrame, nodes: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, efficiency): mean of 1 / hops over all ordered pairs; routing efficiency of an unweighted network."""
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    e = hops(both_ways(edges, keys), keys).groupBy(*keys).agg(F.sum(1 / F.col("d")).alias("e"))
    return n.join(e, keys, "left").select(*keys, F.try_divide(F.coalesce("e", F.lit(0.0)), F.col("n") * F.col("n") - F.col("n")).alias("efficiency"))


def edge_ranges(edges: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, src, dst, range): hops between the ends of an edge once it is taken away (null where no way is left); over two is a shortcut."""
    s = cut(both_ways(edges, keys).select(*keys, "src", "dst").distinct())
    e, ends, d = edges.select(*keys, "src", "dst"), [*keys, "src", "dst"], 0
    found = e.filter("false").withColumn("range", F.lit(0))
    seen = front = cut(e.distinct().withColumn("at", F.col("src")))
    while not front.isEmpty():
        d += 1
        moved = front.join(s.select(*keys, F.col("src").alias("at"), F.col("dst").alias("to")), [*keys, "at"])
        moved = moved.filter(~(((F.col("at") == F.col("src")) & (F.col("to") == F.col("dst"))) | ((F.col("at") == F.col("dst")) & (F.col("to") == F.col("src"))))).select(*ends, F.col("to").alias("at")).distinct()
        moved = cut(moved.join(seen, [*ends, "at"], "left_anti"))
        hit = moved.filter("at = dst").select(*ends)
        found = found.unionByName(hit.withColumn("range", F.lit(d)))
        front = cut(moved.join(hit, ends, "left_anti"))
        seen = seen.unionByName(front)
    return e.join(found, ends, "left")


def cycle_probability(edges: DataFrame, keys: list[str], length: int) -> DataFrame:
    """(keys, q, share): closed walks of length q over all walks of length q."""
    s = both_ways(edges, keys).select(*keys, "src", "dst")
    step, now, out = s.select(*keys, F.col("src").alias("dst"), F.col("dst").alias("__to")), s.withColumn("n", F.lit(1).cast("long")), None
    for q in range(1, length + 1):
        if q > 1:
            now = cut(now.join(step, [*keys, "dst"]).groupBy(*keys, "src", F.col("__to").alias("dst")).agg(F.sum("n").alias("n")))
        part = now.groupBy(*keys).agg(F.try_divide(F.sum(F.when(F.col("src") == F.col("dst"), F.col("n")).otherwise(0)), F.sum("n")).alias("share")).withColumn("q", F.lit(q))
        out = part if out is None else out.unionByName(part)
    return out


def flow_coefficient(arcs: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, flow): ordered neighbour pairs i -> v -> j without i -> j over k(k-1), k the number of neighbours."""
    a = arcs.select(*keys, "src", "dst").filter("src <> dst").distinct()
    k = a.select(*keys, F.col("src").alias("v"), F.col("dst").alias("u")).unionByName(a.select(*keys, F.col("dst").alias("v"), F.col("src").alias("u"))).distinct().groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("k"))
    p = a.select(*keys, F.col("src").alias("i"), F.col("dst").alias("v")).join(a.select(*keys, F.col("src").alias("v"), F.col("dst").alias("j")), [*keys, "v"]).filter("i <> j")
    open_ = p.join(a.select(*keys, F.col("src").alias("i"), F.col("dst").alias("j")), [*keys, "i", "j"], "left_anti").groupBy(*keys, "v").agg(F.count(F.lit(1)).alias("f"))
    return k.join(open_, [*keys, "v"], "left").select(*keys, F.col("v").alias("node"), F.coalesce(F.try_divide(F.col("f"), F.col("k") * (F.col("k") - 1)), F.lit(0.0)).alias("flow"))


def diversity(edges: DataFrame, communities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, h): entropy of a node's strength over communities, by the logarithm of the number of communities."""
    s = both_ways(edges, keys).join(communities.select(*keys, F.col("node").alias("dst"), "community"), [*keys, "dst"])
    k = s.groupBy(*keys, "src", "community").agg(F.sum("w").alias("k"))
    p = k.withColumn("p", F.col("k") / F.sum("k").over(Window.partitionBy(*keys, "src")))
    m = communities.groupBy(*keys).agg(F.count_distinct("community").alias("m"))
    return p.groupBy(*keys, F.col("src").alias("node")).agg((-F.sum(F.col("p") * F.ln("p"))).alias("e")).join(m, keys).select(*keys, "node", F.when(F.col("m") > 1, F.col("e") / F.ln("m")).otherwise(0.0).alias("h"))


def signed_participation(edges: DataFrame, communities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, positive, negative): participation within each sign; null where a node has no such edge."""
    from .network import participation

    p = participation(edges.filter("w > 0"), communities, keys).withColumnRenamed("pc", "positive")
    n = participation(edges.filter("w < 0").withColumn("w", -F.col("w")), communities, keys).withColumnRenamed("pc", "negative")
    return p.join(n, [*keys, "node"], "full")


def binary_rich_club(edges: DataFrame, keys: list[str], directed: bool = False) -> DataFrame:
    """(keys, k, nodes, links, share): density among nodes of degree over k; of arcs if directed, the degree being in-degree plus out-degree."""
    d = degrees(edges, keys, 0.0).select(*keys, "node", "degree")
    top = d.groupBy(*keys).agg(F.max("degree").alias("top"))
    ks = top.select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("top") - 1)).alias("k"))
    n = ks.join(d, keys).filter("degree > k").groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("nodes"))
    e = edges.join(d.select(*keys, F.col("node").alias("src"), F.col("degree").alias("a")), [*keys, "src"]).join(d.select(*keys, F.col("node").alias("dst"), F.col("degree").alias("b")), [*keys, "dst"]).select(*keys, F.least("a", "b").alias("low"))
    m = ks.join(e, keys).filter("low > k").groupBy(*keys, "k").agg(F.count(F.lit(1)).alias("links"))
    return n.join(m, [*keys, "k"], "left").select(*keys, "k", "nodes", F.coalesce("links", F.lit(0)).alias("links"), F.try_divide((1 if directed else 2) * F.coalesce("links", F.lit(0)), F.col("nodes") * (F.col("nodes") - 1)).alias("share"))


def backbone(edges: DataFrame, keys: list[str], max_rounds: int = 32) -> DataFrame:
    """Maximum spanning forest of every network, by Boruvka rounds: each part takes its strongest outgoing edge, ties by src and dst."""
    e = cut(edges.select(*keys, "src", "dst", "w"))
    label = cut(both_ways(e, keys).select(*keys, F.col("src").alias("node")).distinct().withColumn("part", F.col("node")))
    kept = None
    for _ in range(max_rounds):
        a, b = label.select(*keys, F.col("node").alias("src"), F.col("part").alias("pa")), label.select(*keys, F.col("node").alias("dst"), F.col("part").alias("pb"))
        out = e.join(a, [*keys, "src"]).join(b, [*keys, "dst"]).filter("pa <> pb")
        pick = F.max_by(F.struct("src", "dst", "w", "pa", "pb"), F.struct(F.col("w"), -F.col("src"), -F.col("dst"))).alias("p")
        best = out.select("*", F.col("pa").alias("part")).unionByName(out.select("*", F.col("pb").alias("part"))).groupBy(*keys, "part").agg(pick)
        best = cut(best.select(*keys, "p.src", "p.dst", "p.w", "p.pa", "p.pb").distinct())
        if best.isEmpty():
            return kept if kept is not None else e
        kept = best.select(*keys, "src", "dst", "w") if kept is None else kept.unionByName(best.select(*keys, "src", "dst", "w"))
        from .network import components

        merged = components(best.select(*keys, F.col("pa").alias("src"), F.col("pb").alias("dst"), "w"), keys).select(*keys, F.col("node").alias("part"), F.col("component").alias("to"))
        label = cut(label.join(merged, [*keys, "part"], "left").select(*keys, "node", F.coalesce("to", "part").alias("part")))
    raise RuntimeError("spanning forest did not settle")


def hub_scores(nodes: DataFrame, keys: list[str], metrics: list[str]) -> DataFrame:
    """(keys, node, score): sum over metrics of the z-score within the network; a constant metric adds 0."""
    w = Window.partitionBy(*keys)
    parts = [F.coalesce(F.try_divide(F.col(m) - F.avg(m).over(w), F.stddev_samp(m).over(w)), F.lit(0.0)) for m in metrics]
    total = parts[0]
    for p in parts[1:]:
        total = total + p
    return nodes.select(*keys, "node", total.alias("score"))


def role_boundaries(nodes: DataFrame, grain: float = 0.01) -> dict[str, float]:
    """Boundaries of node roles from all nodes (pc, z) of a batch: two groups on z, then three on pc for hubs and for the others, as midpoints
    between the optimal one-dimensional groups. Values are counted on a grid of `grain`, so the search sees a bounded table whatever the
    number of nodes; a split that does not exist falls back to the default."""
    import numpy as np

    from .network import ROLE_CUTS

    def counted(df, value):
        g = df.groupBy(F.round(F.col(value) / grain).alias("v")).agg(F.count(F.lit(1)).alias("c"), F.avg(value).alias("m")).orderBy("v").collect()  # one row per grid value
        return np.array([r["m"] for r in g]), np.array([r["c"] for r in g], float)

    def split(v, c, k):
        if len(v) < k:
            return None
        n, s, q = (np.concatenate([[0], np.cumsum(x)]) for x in (c, c * v, c * v * v))
        cost = lambda i, j: (q[j] - q[i]) - (s[j] - s[i]) ** 2 / (n[j] - n[i])
        m = len(v)
        if k == 2:
            b = [min(range(1, m), key=lambda i: cost(0, i) + cost(i, m))]
        else:
            b = min(((i, j) for i in range(1, m - 1) for j in range(i + 1, m)), key=lambda p: cost(0, p[0]) + cost(*p) + cost(p[1], m))
        return [float((v[i - 1] + v[i]) / 2) for i in b]

    out = dict(ROLE_CUTS)
    if z := split(*counted(nodes.filter("z is not null"), "z"), 2):
        out["hub_z"] = z[0]
    if h := split(*counted(nodes.filter(F.col("z") > out["hub_z"]), "pc"), 3):
        out["provincial_hub"], out["connector_hub"] = h
    if h := split(*counted(nodes.filter(F.col("z") <= out["hub_z"]), "pc"), 3):
        out["peripheral"], out["connector"] = h
    return out


def landscape(nodes: DataFrame, keys: list[str], points: int = 40, bandwidth: tuple[float, float] = (0.05, 0.4), z_range: tuple[float, float] = (-4.0, 6.0)) -> DataFrame:
    """(keys, i, j, pc, z, density, peak): Gaussian density of nodes over a grid of (pc, z), with local maxima marked. Nodes are counted on a fine
    grid first, so the join is between two bounded grids."""
    lo, hi = z_range
    cell = nodes.groupBy(*keys, F.round(F.col("pc") * 100).alias("p"), F.round(F.col("z") * 20).alias("q")).agg(F.count(F.lit(1)).alias("c"))
    total = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    grid = total.withColumn("i", F.explode(F.sequence(F.lit(0), F.lit(points - 1)))).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(points - 1))))
    grid = grid.withColumns({"pc": F.col("i") / (points - 1.0), "z": lo + (hi - lo) * F.col("j") / (points - 1.0)})
    e = F.exp(-0.5 * (F.pow((F.col("pc") - F.col("p") / 100) / bandwidth[0], F.lit(2.0)) + F.pow((F.col("z") - F.col("q") / 20) / bandwidth[1], F.lit(2.0))))
    d = grid.join(cell, keys).groupBy(*keys, "i", "j", "pc", "z", "n").agg((F.sum(F.col("c") * e) / (F.col("n") * 6.283185307179586 * bandwidth[0] * bandwidth[1])).alias("density"))
    around = F.explode(F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b")) for a in (-1, 0, 1) for b in (-1, 0, 1) if a or b))).alias("o")
    near = d.select(*keys, "i", "j", "density", around).select(*keys, (F.col("i") + F.col("o.a")).alias("i"), (F.col("j") + F.col("o.b")).alias("j"), "density").groupBy(*keys, "i", "j").agg(F.max("density").alias("next"))
    return d.join(near, [*keys, "i", "j"]).select(*keys, "i", "j", "pc", "z", "density", (F.col("density") > F.col("next")).alias("peak"))


def nodes_in_all(membership: DataFrame, groups: list[str]) -> DataFrame:
    """(rec, ch) of units that belong to every one of the groups."""
    m = membership.filter(F.col("cell_group").isin(groups)).groupBy("rec", "ch").agg(F.count_distinct("cell_group").alias("k"))
    return m.filter(F.col("k") == len(set(groups))).select("rec", "ch")


def edges_shown(edges: DataFrame, cuts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, n): edges at or above each network's cut."""
    return edges.join(cuts, keys).groupBy(*keys).agg(F.sum((F.col("w") >= F.col("cut")).cast("long")).alias("n"))


def composition(membership: DataFrame, active: DataFrame) -> DataFrame:
    """(rec, cell_group, cells, share, active_cells, active_share) per group; active has rec, ch."""
    total = membership.select("rec", "ch").distinct().groupBy("rec").agg(F.count(F.lit(1)).alias("all"))
    m = membership.join(active.select("rec", "ch").distinct().withColumn("on", F.lit(1)), ["rec", "ch"], "left")
    g = m.groupBy("rec", "cell_group").agg(F.count(F.lit(1)).alias("cells"), F.count("on").alias("active_cells")).join(total, "rec")
    return g.select("rec", "cell_group", "cells", (F.col("cells") / F.col("all")).alias("share"), "active_cells", (F.col("active_cells") / F.col("cells")).alias("active_share"))


def group_means(node_metrics: DataFrame, membership: DataFrame) -> DataFrame:
    """Node metrics (rec, node, metric, value) as means per group: one scalar row per recording, group and metric."""
    m = membership.withColumnRenamed("ch", "node")
    return node_metrics.join(m, ["rec", "node"]).groupBy("rec", "cell_group", "metric").agg(F.avg("value").alias("value"))


def ordered_groups(rows: DataFrame, order: list[str], group: str = "grp") -> DataFrame:
    """rows with `position` of their group in a custom order, from 1; groups not listed come last."""
    at = F.array_position(F.array(*map(F.lit, order)), F.col(group))
    return rows.withColumn("position", F.when(at > 0, at).otherwise(len(order) + 1))


def participation_residual(participation: DataFrame, communities: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, node, residual): participation (keys, node, pc) less its least-squares line on the size of the node's community. Members without edges
    take part in the fit with 0 and have residual 0; so has every node where all communities are of one size."""
    size = communities.groupBy(*keys, "community").agg(F.count(F.lit(1)).cast("double").alias("size"))
    p = communities.join(size, [*keys, "community"]).join(participation.select(*keys, "node", "pc"), [*keys, "node"], "left").withColumn("y", F.coalesce("pc", F.lit(0.0)))
    line = p.groupBy(*keys).agg(F.min("size").alias("least"), F.max("size").alias("most"), F.regr_slope("y", "size").alias("slope"), F.regr_intercept("y", "size").alias("level"))
    fitted = (F.col("pc").isNotNull()) & (F.col("least") < F.col("most"))
    return p.join(line, keys).select(*keys, "node", F.when(fitted, F.col("y") - F.col("level") - F.col("slope") * F.col("size")).otherwise(0.0).alias("residual"))


def gateway(edges: DataFrame, communities: DataFrame, keys: list[str], centrality: DataFrame | None = None) -> DataFrame:
    """(keys, node, gateway): participation whose shares are weighed by how much of the link between two communities runs through the node and how
    central its neighbours there are (Vargas and Wahl 2014). Weights are positive; centrality (keys, node, value) is the strength if not given."""
    s = both_ways(edges, keys)
    value = centrality if centrality is not None else s.groupBy(*keys, F.col("src").alias("node")).agg(F.sum("w").alias("value"))
    members = communities.select(*keys, "node", "community")
    ends = members.join(value.select(*keys, "node", "value"), [*keys, "node"], "left")
    top = ends.groupBy(*keys, "community").agg(F.sum("value").alias("v"), F.count(F.lit(1)).alias("size"))
    most = top.groupBy(*keys).agg(F.max("v").alias("most"))
    to = s.join(ends.withColumnRenamed("node", "dst"), [*keys, "dst"]).groupBy(*keys, "src", "community").agg(F.sum("w").alias("k"), F.sum("value").alias("c"))
    own = to.join(members.select(*keys, F.col("node").alias("src"), F.col("community").alias("own")), [*keys, "src"])
    halved = F.when(F.col("own") == F.col("community"), 2.0).otherwise(1.0)
    links = own.groupBy(*keys, "own", "community").agg(F.sum("k").alias("links")).join(top.select(*keys, F.col("community").alias("own"), "size"), [*keys, "own"])
    links = links.select(*keys, "own", "community", F.when(F.col("size") > 1, F.col("links") / halved).alias("links"))
    g = own.join(links, [*keys, "own", "community"]).join(most, keys)
    kept = 1 - F.coalesce(F.try_divide("k", "links") * F.try_divide("c", "most"), F.lit(0.0))
    part = g.select(*keys, "src", "k", (F.col("k") * F.col("k") * kept * kept).alias("x")).groupBy(*keys, F.col("src").alias("node")).agg(F.sum("x").alias("x"), F.sum("k").alias("k"))
    return part.select(*keys, "node", F.when(F.col("k") > 0, 1 - F.col("x") / (F.col("k") * F.col("k"))).otherwise(0.0).alias("gateway"))
