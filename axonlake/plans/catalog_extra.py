"""Queries of the directed, signed and binary network metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.iterate import cut
from ..operators import graph_extra as g
from ..operators import density, network
from ..sources import views
from .catalog import KEY, _communities, _rounded, query, steps, tiling_network

_ARCS = "arcs AS (SELECT rec, src, dst FROM steps)"
_LINKS = """l AS (SELECT rec, least(src, dst) AS u, greatest(src, dst) AS v, count(*)::DOUBLE AS k FROM arcs GROUP BY ALL), e AS (SELECT rec, u AS x, v AS y, k FROM l UNION ALL SELECT rec, v, u, k FROM l)"""


def _arcs(spark, d):
    return steps(spark, d).withColumn("w", F.lit(1.0))


def _signed(spark, d):
    return views.supplier_edges(spark, d).withColumn("w", F.when((F.col("src") + F.col("dst")) % 3 == 0, -F.col("w")).otherwise(F.col("w")))


@query("signed_strengths", """WITH s AS (SELECT rec, src, CASE WHEN (src + dst) % 3 = 0 THEN -w ELSE w END AS w FROM sym), a AS (SELECT rec, src AS node, sum(CASE WHEN w > 0 THEN w ELSE 0 END) AS positive, sum(CASE WHEN w < 0 THEN -w ELSE 0 END) AS negative FROM s GROUP BY ALL)
    SELECT *, sum(positive) OVER (PARTITION BY rec) AS total_positive, sum(negative) OVER (PARTITION BY rec) AS total_negative FROM a""")
def signed_strengths(spark, d):
    return g.signed_strengths(_signed(spark, d), KEY)


@query("directed_density", f"WITH {_ARCS}, n AS (SELECT rec, count(*) AS n FROM (SELECT rec, src FROM arcs UNION SELECT rec, dst FROM arcs) GROUP BY rec), m AS (SELECT rec, count(*) AS m FROM arcs GROUP BY rec) SELECT rec, round(m / (n * n - n), 6) AS density FROM n JOIN m USING (rec)")
def directed_density(spark, d):
    return _rounded(g.directed_density(_arcs(spark, d), KEY))


@query("joint_degrees", f"WITH {_ARCS}, n AS (SELECT rec, src AS v FROM arcs UNION SELECT rec, dst FROM arcs), k AS (SELECT n.rec, n.v, (SELECT count(*) FROM arcs a WHERE a.rec = n.rec AND a.dst = n.v) AS indegree, (SELECT count(*) FROM arcs a WHERE a.rec = n.rec AND a.src = n.v) AS outdegree FROM n) SELECT rec, indegree, outdegree, count(*) AS nodes FROM k GROUP BY ALL")
def joint_degrees(spark, d):
    return network.joint_degrees(_arcs(spark, d), KEY)


@query("directed_clustering", f"""WITH {_ARCS}, {_LINKS}, t AS (SELECT a.rec, a.x, sum(a.k * b.k * c.k) / 2 AS t FROM e a JOIN e b ON a.rec = b.rec AND a.y = b.x JOIN e c ON c.rec = b.rec AND c.x = b.y AND c.y = a.x GROUP BY ALL),
    k AS (SELECT rec, x, sum(k) AS k, count(*) FILTER (k = 2) AS r FROM e GROUP BY ALL)
    SELECT rec, x AS node, coalesce(t, 0) AS cycles, (k * (k - 1) - 2 * r)::BIGINT AS possible, round(CASE WHEN t IS NULL THEN 0 ELSE t / (k * (k - 1) - 2 * r) END, 6) AS cc FROM k LEFT JOIN t USING (rec, x)""")
def directed_clustering(spark, d):
    return _rounded(g.directed_clustering(_arcs(spark, d), KEY))


@query("directed_transitivity", f"""WITH {_ARCS}, {_LINKS}, t AS (SELECT a.rec, sum(a.k * b.k * c.k) / 2 AS t FROM e a JOIN e b ON a.rec = b.rec AND a.y = b.x JOIN e c ON c.rec = b.rec AND c.x = b.y AND c.y = a.x GROUP BY a.rec),
    k AS (SELECT rec, sum(k * (k - 1) - 2 * r) AS p FROM (SELECT rec, x, sum(k) AS k, count(*) FILTER (k = 2) AS r FROM e GROUP BY ALL) GROUP BY rec) SELECT rec, round(CASE WHEN p <> 0 THEN coalesce(t, 0) / p END, 6) AS transitivity FROM k LEFT JOIN t USING (rec)""")
def directed_transitivity(spark, d):
    return _rounded(g.directed_transitivity(_arcs(spark, d), KEY))


@query("signed_clustering")
def signed_clustering(spark, d):
    return _rounded(g.signed_clustering(_signed(spark, d), KEY))


@query("hop_distances", f"""WITH RECURSIVE {_ARCS}, w(rec, src, dst, d) USING KEY (rec, src, dst) AS (SELECT rec, src, dst, 1 FROM arcs UNION
    SELECT x.rec, x.src, x.dst, x.d FROM (SELECT w.rec, w.src, a.dst, min(w.d) + 1 AS d FROM w JOIN arcs a ON a.rec = w.rec AND a.src = w.dst GROUP BY ALL) x
    LEFT JOIN recurring.w k ON k.rec = x.rec AND k.src = x.src AND k.dst = x.dst WHERE k.d IS NULL) SELECT rec, src, dst, d::INT AS d FROM w WHERE src <> dst""")
def hop_distances(spark, d):
    return g.hops(_arcs(spark, d), KEY)


@query("binary_efficiency")
def binary_efficiency(spark, d):
    e = tiling_network(spark, d)
    return _rounded(g.binary_efficiency(e, network.degrees(e, KEY), KEY))


@query("edge_ranges")
def edge_ranges(spark, d):
    return g.edge_ranges(tiling_network(spark, d), KEY)


@query("cycle_probability", """WITH s AS (SELECT rec, src, dst FROM netsym), a AS (SELECT a.rec, a.src, b.dst FROM s a JOIN s b ON a.rec = b.rec AND a.dst = b.src), b AS (SELECT a.rec, a.src, s.dst FROM a JOIN s ON a.rec = s.rec AND a.dst = s.src)
    SELECT rec, 1 AS q, 0.0::DOUBLE AS share FROM s GROUP BY rec UNION ALL SELECT rec, 2, round(count(*) FILTER (src = dst) / count(*), 6) FROM a GROUP BY rec UNION ALL SELECT rec, 3, round(count(*) FILTER (src = dst) / count(*), 6) FROM b GROUP BY rec""")
def cycle_probability(spark, d):
    return _rounded(g.cycle_probability(tiling_network(spark, d), KEY, 3))


@query("flow_coefficient", f"""WITH {_ARCS}, k AS (SELECT rec, v, count(*) AS k FROM (SELECT rec, src AS v, dst AS u FROM arcs UNION SELECT rec, dst, src FROM arcs) GROUP BY ALL),
    f AS (SELECT a.rec, a.dst AS v, count(*) AS f FROM arcs a JOIN arcs b ON a.rec = b.rec AND a.dst = b.src AND a.src <> b.dst WHERE NOT EXISTS (SELECT 1 FROM arcs c WHERE c.rec = a.rec AND c.src = a.src AND c.dst = b.dst) GROUP BY ALL)
    SELECT k.rec, k.v AS node, round(coalesce(CASE WHEN k > 1 THEN f / (k * (k - 1)) END, 0), 6) AS flow FROM k LEFT JOIN f ON f.rec = k.rec AND f.v = k.v""")
def flow_coefficient(spark, d):
    return _rounded(g.flow_coefficient(_arcs(spark, d), KEY))


@query("community_diversity", """WITH m AS (SELECT sym.rec, src, community, sum(w) AS k FROM sym JOIN comm ON comm.rec = sym.rec AND comm.node = dst GROUP BY ALL), p AS (SELECT rec, src, k / sum(k) OVER (PARTITION BY rec, src) AS p FROM m),
    n AS (SELECT rec, count(DISTINCT community) AS m FROM comm GROUP BY rec) SELECT rec, src AS node, round(-sum(p * ln(p)) / ln(any_value(m)), 6) AS h FROM p JOIN n USING (rec) GROUP BY rec, src""")
def community_diversity(spark, d):
    e = views.supplier_edges(spark, d)
    return _rounded(g.diversity(e, _communities(e), KEY))


@query("signed_participation")
def signed_participation(spark, d):
    e = _signed(spark, d)
    return _rounded(g.signed_participation(e, _communities(e), KEY))


@query("binary_rich_club", """WITH s AS (SELECT rec, src, dst FROM net), d AS (SELECT rec, n, count(*) AS k FROM (SELECT rec, src AS n FROM s UNION ALL SELECT rec, dst FROM s) GROUP BY ALL),
    ks AS (SELECT rec, unnest(range(max(k))) AS k FROM d GROUP BY rec), a AS (SELECT ks.rec, ks.k, count(*) AS nodes FROM ks JOIN d ON d.rec = ks.rec AND d.k > ks.k GROUP BY ALL),
    m AS (SELECT ks.rec, ks.k, count(*) AS links FROM ks JOIN s ON s.rec = ks.rec JOIN d x ON x.rec = s.rec AND x.n = s.src JOIN d y ON y.rec = s.rec AND y.n = s.dst WHERE least(x.k, y.k) > ks.k GROUP BY ALL)
    SELECT rec, k, nodes, coalesce(links, 0) AS links, round(CASE WHEN nodes > 1 THEN 2 * coalesce(links, 0) / (nodes * (nodes - 1)) END, 6) AS share FROM a LEFT JOIN m USING (rec, k)""")
def binary_rich_club(spark, d):
    return _rounded(g.binary_rich_club(tiling_network(spark, d), KEY))


@query("directed_rich_club", f"""WITH {_ARCS}, d AS (SELECT rec, n, count(*) AS k FROM (SELECT rec, src AS n FROM arcs UNION ALL SELECT rec, dst FROM arcs) GROUP BY ALL),
    ks AS (SELECT rec, unnest(range(max(k))) AS k FROM d GROUP BY rec), a AS (SELECT ks.rec, ks.k, count(*) AS nodes FROM ks JOIN d ON d.rec = ks.rec AND d.k > ks.k GROUP BY ALL),
    l AS (SELECT s.rec, least(x.k, y.k) AS low, count(*) AS n FROM arcs s JOIN d x ON x.rec = s.rec AND x.n = s.src JOIN d y ON y.rec = s.rec AND y.n = s.dst GROUP BY ALL),
    m AS (SELECT ks.rec, ks.k, sum(n)::BIGINT AS links FROM ks JOIN l ON l.rec = ks.rec AND l.low > ks.k GROUP BY ALL)
    SELECT rec, k, nodes, coalesce(links, 0) AS links, round(CASE WHEN nodes > 1 THEN coalesce(links, 0) / (nodes * (nodes - 1)) END, 6) AS share FROM a LEFT JOIN m USING (rec, k)""")
def directed_rich_club(spark, d):
    return _rounded(g.binary_rich_club(_arcs(spark, d), KEY, directed=True))


@query("directed_core")
def directed_core(spark, d):
    return network.k_core(_arcs(spark, d), KEY, 3).select(*KEY, "src", "dst")


@query("backbone")
def backbone(spark, d):
    return g.backbone(tiling_network(spark, d), KEY)


@query("hub_scores", """SELECT rec, node, round(coalesce((k - avg(k) OVER w) / nullif(stddev_samp(k) OVER w, 0), 0) + coalesce((s - avg(s) OVER w) / nullif(stddev_samp(s) OVER w, 0), 0), 6) AS score FROM deg WINDOW w AS (PARTITION BY rec)""")
def hub_scores(spark, d):
    return _rounded(g.hub_scores(network.degrees(views.supplier_edges(spark, d), KEY), KEY, ["degree", "strength"]))


def _nodes(spark, d):
    e = cut(views.supplier_edges(spark, d))  # read six times
    c = cut(_communities(e))
    return network.participation(e, c, KEY).join(network.module_zscore(e, c, KEY), ["rec", "node"])


@query("batch_roles")
def batch_roles(spark, d):
    n = cut(_nodes(spark, d))  # read four times
    return network.roles(n, g.role_boundaries(n)).groupBy("rec", "role").agg(F.count(F.lit(1)).alias("n"))


@query("role_landscape")
def role_landscape(spark, d):
    return _rounded(g.landscape(_nodes(spark, d), KEY, 20))


@query("role_basins")
def role_basins(spark, d):
    n = cut(_nodes(spark, d))  # read six times below
    basins = density.density_basins(n, KEY, "pc", "z", depth=0.1)
    top = basins.filter("peak").select(*KEY, "basin", F.col("x").alias("pc"), F.col("y").alias("z"), "density")
    size = density.basin_of(n, basins, KEY, "pc", "z").groupBy(*KEY, "basin").agg(F.count(F.lit(1)).alias("nodes"))
    return _rounded(top.join(size, [*KEY, "basin"], "left").select(*top.columns, F.coalesce("nodes", F.lit(0)).alias("nodes")))


_MEMBERS = "mem AS (SELECT 1 AS rec, s_suppkey + 1 AS ch, 'a' AS cell_group FROM supplier WHERE s_nationkey % 3 = 0 UNION ALL SELECT 1, s_suppkey + 1, 'b' FROM supplier WHERE s_nationkey % 2 = 0)"


def _members(spark, d):
    s = views.table(spark, d, "supplier").select(F.lit(1).alias("rec"), (F.col("s_suppkey") + 1).alias("ch"), "s_nationkey", "s_acctbal")
    a = s.filter("s_nationkey % 3 = 0").select("rec", "ch", F.lit("a").alias("cell_group"))
    return a.unionByName(s.filter("s_nationkey % 2 = 0").select("rec", "ch", F.lit("b").alias("cell_group"))), s


@query("cells_in_all_groups", f"WITH {_MEMBERS} SELECT rec, ch FROM mem GROUP BY rec, ch HAVING count(DISTINCT cell_group) = 2")
def cells_in_all_groups(spark, d):
    return g.nodes_in_all(_members(spark, d)[0], ["a", "b"])


@query("cell_composition", f"""WITH {_MEMBERS}, n AS (SELECT count(DISTINCT ch) AS n FROM mem)
    SELECT rec, cell_group, count(*) AS cells, round(count(*) / any_value(n), 6) AS share, count(*) FILTER (s_acctbal > 0) AS active_cells, round(count(*) FILTER (s_acctbal > 0) / count(*), 6) AS active_share FROM mem JOIN supplier ON s_suppkey + 1 = ch, n GROUP BY ALL""")
def cell_composition(spark, d):
    m, s = _members(spark, d)
    return _rounded(g.composition(m, s.filter("s_acctbal > 0")))


@query("group_metric_means", f"WITH {_MEMBERS} SELECT rec, cell_group, 'balance' AS metric, round(avg(s_acctbal), 6) AS value FROM mem JOIN supplier ON s_suppkey + 1 = ch GROUP BY ALL")
def group_metric_means(spark, d):
    m, s = _members(spark, d)
    return _rounded(g.group_means(s.select("rec", F.col("ch").alias("node"), F.lit("balance").alias("metric"), F.col("s_acctbal").alias("value")), m))


@query("edges_shown", "WITH c AS (SELECT rec, quantile_cont(w, 0.9) AS cut FROM edges GROUP BY rec) SELECT rec, count(*) FILTER (w >= cut) AS n FROM edges JOIN c USING (rec) GROUP BY rec")
def edges_shown(spark, d):
    from ..operators import connectivity as conn

    e = views.supplier_edges(spark, d)
    return g.edges_shown(e, conn.percentile_cut(e, network.degrees(e, KEY), KEY, 0.9, of_all_entries=False), KEY)


@query("ordered_groups", "SELECT c_custkey, CASE c_mktsegment WHEN 'MACHINERY' THEN 1 WHEN 'BUILDING' THEN 2 ELSE 3 END::BIGINT AS position FROM customer")
def ordered_groups(spark, d):
    return g.ordered_groups(views.table(spark, d, "customer"), ["MACHINERY", "BUILDING"], "c_mktsegment").select("c_custkey", F.col("position").cast("long").alias("position"))


@query("resampled_frames")
def resampled_frames(spark, d):
    from ..operators import signal

    return _rounded(signal.resample(views.frames(spark, d), 33.3, 10.0))


@query("zscore_burst_counts")
def zscore_burst_counts(spark, d):
    from ..operators import events as ev

    return ev.zscore_burst_counts(views.spikes(spark, d), views.channels(spark, d), views.recordings(spark, d), 3600.0)


@query("imaging_cells", "SELECT s_nationkey AS rec, s_suppkey AS roi FROM supplier WHERE s_acctbal > 0 AND s_suppkey IN (SELECT l_suppkey FROM lineitem WHERE l_quantity = 50 AND l_discount > 0.09)")
def imaging_cells(spark, d):
    from ..operators import signal

    rois = views.table(spark, d, "supplier").select(F.col("s_nationkey").alias("rec"), F.col("s_suppkey").alias("roi"), (F.col("s_acctbal") > 0).alias("is_cell"))
    peaks = views.table(spark, d, "lineitem").filter("l_quantity = 50 AND l_discount > 0.09").select(F.col("l_suppkey").alias("roi")).join(rois.select("rec", "roi"), "roi")
    return signal.keep_cells(rois, peaks).select("rec", "roi")


@query("participation_residual", """WITH m AS (SELECT sym.rec, src, community, sum(w) AS k FROM sym JOIN comm ON comm.rec = sym.rec AND comm.node = dst GROUP BY ALL), p AS (SELECT rec, src AS node, 1 - sum(k * k) / (sum(k) * sum(k)) AS pc FROM m GROUP BY rec, src),
    z AS (SELECT rec, community, count(*)::DOUBLE AS n FROM comm GROUP BY ALL), a AS (SELECT comm.rec, comm.node, n, pc FROM comm JOIN z USING (rec, community) JOIN p USING (rec, node)),
    f AS (SELECT rec, min(n) AS lo, max(n) AS hi, regr_slope(pc, n) AS b, regr_intercept(pc, n) AS c FROM a GROUP BY rec)
    SELECT rec, node, round(CASE WHEN lo < hi THEN pc - c - b * n ELSE 0 END, 6) + 0.0 AS residual FROM a JOIN f USING (rec)""")
def participation_residual(spark, d):
    e = views.supplier_edges(spark, d)
    c = _communities(e)
    return _rounded(g.participation_residual(network.participation(e, c, KEY), c, KEY))


@query("gateway", """WITH q AS (SELECT sym.rec, sym.src, w, community AS o, s AS cent FROM sym JOIN comm ON comm.rec = sym.rec AND comm.node = sym.dst JOIN deg ON deg.rec = sym.rec AND deg.node = sym.dst),
    p AS (SELECT q.rec, q.src, community AS own, o, sum(w) AS k, sum(cent) AS c FROM q JOIN comm ON comm.rec = q.rec AND comm.node = q.src GROUP BY ALL), z AS (SELECT rec, community AS own, count(*) AS n FROM comm GROUP BY ALL),
    b AS (SELECT rec, own, o, sum(k) / CASE WHEN own = o THEN 2 ELSE 1 END AS b FROM p GROUP BY rec, own, o), t AS (SELECT comm.rec, sum(s) AS t FROM comm JOIN deg USING (rec, node) GROUP BY comm.rec, community), m AS (SELECT rec, max(t) AS m FROM t GROUP BY rec)
    SELECT p.rec, src AS node, round(1 - sum(k * k * (1 - CASE WHEN n > 1 THEN k / b * c / m ELSE 0 END) ** 2) / sum(k) ** 2, 6) AS gateway FROM p JOIN z USING (rec, own) JOIN b USING (rec, own, o) JOIN m USING (rec) GROUP BY p.rec, src""")
def gateway(spark, d):
    e = views.supplier_edges(spark, d)
    return _rounded(g.gateway(e, _communities(e), KEY))


@query("weighted_agreement", """WITH p AS (SELECT c_nationkey AS rec, c_custkey AS n, unnest([1, 2]) AS run, unnest([c_mktsegment, (c_acctbal > 0)::VARCHAR]) AS community FROM customer)
    SELECT a.rec, a.n AS src, b.n AS dst, round(sum(CASE a.run WHEN 1 THEN 0.75 ELSE 0.25 END::DOUBLE), 6) AS n FROM p a JOIN p b ON a.rec = b.rec AND a.run = b.run AND a.community = b.community AND a.n < b.n GROUP BY ALL""")
def weighted_agreement(spark, d):
    c = views.table(spark, d, "customer")
    kinds = F.explode(F.array(*(F.struct(F.lit(i).alias("run"), x.alias("community"), F.lit(w).alias("weight")) for i, x, w in ((1, F.col("c_mktsegment"), 3.0), (2, (F.col("c_acctbal") > 0).cast("string"), 1.0)))))
    p = c.select(F.col("c_nationkey").alias("rec"), F.col("c_custkey").alias("node"), kinds.alias("x")).select("rec", "node", "x.*")
    return network.agreement(p, KEY, weights=p.select("rec", "run", "weight").distinct(), digits=6)


def _cells(spark, d):
    li = views.table(spark, d, "lineitem").join(views.table(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return li.select(F.col("l_linestatus").alias("metric"), F.col("s_nationkey").alias("subject"), (F.col("l_discount") > 0.05).alias("a"), F.col("l_linenumber").alias("b"), F.col("l_extendedprice").alias("value"))


@query("two_way_repeated_anova", """WITH v AS (SELECT l_linestatus AS metric, s_nationkey AS s, l_discount > 0.05 AS a, l_linenumber AS b, avg(l_extendedprice) AS x FROM lineitem JOIN supplier ON l_suppkey = s_suppkey GROUP BY ALL),
    z AS (SELECT metric, count(DISTINCT a) * count(DISTINCT b) AS n FROM v GROUP BY metric), h AS (SELECT metric, s FROM v JOIN z USING (metric) GROUP BY metric, s, n HAVING count(*) = n),
    w AS (SELECT metric, s, a, b, x, avg(x) OVER (PARTITION BY metric) AS g, avg(x) OVER (PARTITION BY metric, s) AS ms, avg(x) OVER (PARTITION BY metric, a) AS ma, avg(x) OVER (PARTITION BY metric, b) AS mb,
    avg(x) OVER (PARTITION BY metric, s, a) AS msa, avg(x) OVER (PARTITION BY metric, s, b) AS msb, avg(x) OVER (PARTITION BY metric, a, b) AS mab FROM v JOIN h USING (metric, s)),
    t AS (SELECT metric, count(DISTINCT s) - 1 AS n, count(DISTINCT a) - 1 AS p, count(DISTINCT b) - 1 AS q, sum((ma - g) ** 2) AS ssa, sum((mb - g) ** 2) AS ssb, sum((mab - ma - mb + g) ** 2) AS ssab, sum((msa - ms - ma + g) ** 2) AS ea,
    sum((msb - ms - mb + g) ** 2) AS eb, sum((x - msa - msb - mab + ms + ma + mb - g) ** 2) AS eab FROM w GROUP BY metric)
    SELECT metric, 'a' AS effect, round(ssa / p / (ea / (p * n)), 4) AS f, p AS df1, p * n AS df2 FROM t UNION ALL SELECT metric, 'b', round(ssb / q / (eb / (q * n)), 4), q, q * n FROM t
    UNION ALL SELECT metric, 'a:b', round(ssab / (p * q) / (eab / (p * q * n)), 4), p * q, p * q * n FROM t""")
def two_way_repeated_anova(spark, d):
    from ..operators import stats

    return _rounded(stats.two_way_repeated_anova(_cells(spark, d), ["metric"], "subject", "a", "b"), 4)


@query("metric_intervals")
def metric_intervals(spark, d):
    from ..operators import stats

    return _rounded(stats.t_interval(_cells(spark, d), ["metric", "subject"]), 4)


@query("onset_blank_snap", """WITH e AS (SELECT event_type AS rec, user_id % 16 AS ch, event_id AS i, value AS v FROM events), m AS (SELECT rec, ch, quantile_cont(v, 0.5) AS mid, avg(v) AS mu FROM e GROUP BY ALL),
    s AS (SELECT e.rec, e.ch, quantile_cont(abs(v - mu), 0.5) AS mad FROM e JOIN m USING (rec, ch) GROUP BY ALL), h AS (SELECT e.rec, e.ch, i + 1 AS t FROM e JOIN m USING (rec, ch) JOIN s USING (rec, ch) WHERE abs(v - mid) > 3 * mad),
    b AS (SELECT h.rec, h.ch, (SELECT max(i) FROM e WHERE e.rec = h.rec AND e.ch = 0 AND e.i < h.t) AS ts FROM h) SELECT rec, ch, ts::DOUBLE AS ts FROM b WHERE ts IS NOT NULL""")
def onset_blank_snap(spark, d):
    from ..operators import stimulus

    s = views.table(spark, d, "events").select(F.col("event_type").alias("rec"), (F.col("user_id") % 16).alias("ch"), F.col("event_id").alias("frame"), F.col("value").alias("v"))
    template = s.filter("ch = 0").select("rec", F.col("frame").cast("double").alias("ts"))
    return stimulus.onsets_by_median_z(s, template, 3.0, 0, 1.0)


@query("response_table")
def response_table(spark, d):
    from ..operators import stimulus
    from .catalog import _stim

    s = views.spikes(spark, d)
    return _rounded(stimulus.response_table(s, _stim(spark, d), views.channels(spark, d), 0.0, 7200.0, 60.0, fwhm=600.0, points=200, stimulated=s.filter("ch = 0").select("rec", "ch")))
