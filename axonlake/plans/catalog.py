"""Named queries over the driver's tables, and the equivalent SQL. Computed doubles are rounded on both sides."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import scalars
from ..functions.iterate import cut
from ..operators import connectivity as conn
from ..operators import events as ev
from ..operators import joins, kernels, network, signal, stats, stimulus, templates
from ..sources import tables, views

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

# ---- SQL views that mirror axonlake.sources.views ------------------------------------------------------------------------------------

_SPIKES = f"spikes AS (SELECT event_type AS rec, user_id % 16 AS ch, (epoch_us(ts) - {views.START_US}) / 1e6 AS t, value FROM events)"
_RECS = f"recs AS (SELECT DISTINCT event_type AS rec, length(event_type)::BIGINT AS rec_no, {views.SPAN_S}::DOUBLE AS duration_s FROM events)"
_CHANS = "chans AS (SELECT rec, unnest(range(16)) AS ch FROM recs)"
_EDGES = """edges AS (SELECT a.rec, a.l_suppkey AS src, b.l_suppkey AS dst, count(*)::DOUBLE AS w FROM
    (SELECT DISTINCT l_returnflag || year(l_shipdate)::VARCHAR AS rec, l_partkey, l_suppkey FROM lineitem) a JOIN
    (SELECT DISTINCT l_returnflag || year(l_shipdate)::VARCHAR AS rec, l_partkey, l_suppkey FROM lineitem) b
    ON a.rec = b.rec AND a.l_partkey = b.l_partkey AND a.l_suppkey < b.l_suppkey GROUP BY ALL)"""
_SYM = "sym AS (SELECT rec, src, dst, w FROM edges UNION ALL SELECT rec, dst, src, w FROM edges)"
_DEG = "deg AS (SELECT rec, src AS node, count(*) AS k, sum(w) AS s FROM sym GROUP BY rec, src)"
_FRAMES = "frames AS (SELECT label AS rec, vec_id AS frame, unnest(range(64)) AS roi, unnest(embedding)::DOUBLE AS f FROM embeddings)"
_COMM = "comm AS (SELECT rec, node, node % 5 AS community FROM deg)"
_TILING = """WITH u AS (SELECT DISTINCT rec, ch, t FROM spikes), p AS (SELECT 1800.0::DOUBLE AS dt, 2592000.0::DOUBLE AS dur),
    g AS (SELECT rec, ch, t, t - lag(t) OVER (PARTITION BY rec, ch ORDER BY t) AS g FROM u),
    a AS (SELECT rec, ch, count(*) AS n, sum(CASE WHEN g < 2 * dt THEN 2 * dt - g ELSE 0 END) AS o, min(t) AS f, max(t) AS l FROM g, p GROUP BY rec, ch),
    ta AS (SELECT rec, ch, n, (2 * n * dt - o + CASE WHEN f < dt THEN f - dt ELSE 0 END + CASE WHEN n = 1 AND f < dt THEN 0 WHEN dur - l < dt THEN dur - l - dt ELSE 0 END) / dur AS ta FROM a, p),
    h AS (SELECT x.rec, x.ch AS a, y.ch AS b, count(DISTINCT x.t) AS h FROM u x JOIN u y ON x.rec = y.rec AND x.ch <> y.ch AND abs(x.t - y.t) <= 1800 GROUP BY ALL),
    w AS (SELECT A.rec, A.ch AS src, B.ch AS dst, h1.h / A.n AS pa, coalesce(h2.h, 0) / B.n AS pb, A.ta AS ta, B.ta AS tb FROM ta A JOIN ta B ON A.rec = B.rec AND A.ch < B.ch
    JOIN h h1 ON h1.rec = A.rec AND h1.a = A.ch AND h1.b = B.ch LEFT JOIN h h2 ON h2.rec = A.rec AND h2.a = B.ch AND h2.b = A.ch),
    tiling AS (SELECT rec, src, dst, 0.5 * ((pa - tb) / (1 - pa * tb) + (pb - ta) / (1 - pb * ta)) AS w FROM w)"""
_NET = f"net AS ({_TILING} SELECT rec, src, dst, w FROM tiling WHERE w > 0)"
_NETSYM = "netsym AS (SELECT rec, src, dst, w FROM net UNION ALL SELECT rec, dst, src, w FROM net)"
_STEPS = """steps AS (SELECT a.l_returnflag || year(a.l_shipdate)::VARCHAR AS rec, a.l_suppkey AS src, b.l_suppkey AS dst, count(*)::DOUBLE AS w
    FROM lineitem a JOIN lineitem b ON a.l_orderkey = b.l_orderkey AND b.l_linenumber = a.l_linenumber + 1 WHERE a.l_suppkey <> b.l_suppkey GROUP BY ALL)"""
KEY = ["rec"]


def query(name: str, sql: str | None = None):
    """Register a query; sql starts after WITH and may use the views above by name."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            known = {"spikes": _SPIKES, "recs": _RECS, "chans": _CHANS, "edges": _EDGES, "sym": _SYM, "deg": _DEG, "frames": _FRAMES, "comm": _COMM, "net": _NET, "netsym": _NETSYM, "steps": _STEPS}
            needs = {"chans": ["recs"], "sym": ["edges"], "deg": ["edges", "sym"], "comm": ["edges", "sym", "deg"], "net": ["spikes"], "netsym": ["spikes", "net"]}
            words = set(re.findall(r"\w+", sql))
            use = {k for k in known if k in words}
            use |= {x for k in list(use) for x in needs.get(k, [])}
            views_ = ", ".join(known[k] for k in known if k in use)
            body = sql.strip()
            if body.startswith("WITH RECURSIVE "):
                ORACLE[name] = f"WITH RECURSIVE {views_}, {body[15:]}" if views_ else body
            elif body.startswith("WITH "):
                ORACLE[name] = f"WITH {views_}, {body[5:]}" if views_ else body
            else:
                ORACLE[name] = f"WITH {views_} {body}" if views_ else body
        return fn

    return add


def r(c, digits: int = 6):
    return F.round(c, digits)


def _rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.select(*(F.round(c, digits).alias(c) if k == "double" else F.col(c) for c, k in df.dtypes))


# ---- rates, gaps, runs, histograms ----------------------------------------------------------------------------------------------------


@query("firing_rate_summary", """WITH n AS (SELECT c.rec, c.ch, count(s.t) / 2592000.0 * 1000 AS rate FROM chans c LEFT JOIN spikes s ON c.rec = s.rec AND c.ch = s.ch GROUP BY c.rec, c.ch),
    g AS (SELECT rec, round_even(avg(rate), 3) AS fr_mean, round_even(stddev_samp(rate), 3) AS fr_std, round_even(quantile_cont(rate, 0.5), 3) AS fr_median,
    round_even(quantile_cont(rate, 0.75) - quantile_cont(rate, 0.25), 3) AS fr_iqr, count(*) AS n_active FROM n WHERE rate >= 0.001 GROUP BY rec)
    SELECT *, round_even(fr_std / sqrt(n_active), 3) AS fr_sem FROM g""")
def firing_rate_summary(spark, d):
    rates = ev.firing_rates(views.spikes(spark, d), views.channels(spark, d), views.recordings(spark, d))
    return ev.rate_summary(rates.withColumn("rate", F.col("rate") * 1000), 0.001)


@query("firing_rates", "SELECT c.rec, c.ch, count(s.t) AS n, round(count(s.t) / 2592000.0, 9) AS rate FROM chans c LEFT JOIN spikes s ON c.rec = s.rec AND c.ch = s.ch GROUP BY c.rec, c.ch")
def firing_rates(spark, d):
    return _rounded(ev.firing_rates(views.spikes(spark, d), views.channels(spark, d), views.recordings(spark, d)), 9)


@query("active_channels", "SELECT rec, count(DISTINCT ch) AS n FROM spikes WHERE value > 100 GROUP BY rec")
def active_channels(spark, d):
    return views.spikes(spark, d).filter("value > 100").groupBy("rec").agg(F.count_distinct("ch").alias("n"))


@query("drop_grounded", "SELECT rec, ch, count(*) AS n FROM spikes WHERE ch NOT IN (3, 15) GROUP BY rec, ch")
def drop_grounded(spark, d):
    rec = views.recordings(spark, d).withColumn("ground", F.array(F.lit(3).cast("long"), F.lit(15).cast("long")))
    return ev.drop_grounded(views.spikes(spark, d), rec).groupBy("rec", "ch").agg(F.count(F.lit(1)).alias("n"))


@query("truncate_recording", "SELECT rec, count(*) AS n, 604800.0::DOUBLE AS duration_s FROM spikes WHERE t <= 604800 GROUP BY rec")
def truncate_recording(spark, d):
    s, rec = ev.truncate(views.spikes(spark, d), views.recordings(spark, d), 604800.0)
    return s.groupBy("rec").agg(F.count(F.lit(1)).alias("n")).join(rec.select("rec", "duration_s"), "rec")


@query("silent_recordings", "SELECT r.rec, count(s.t) > 0 AS any_events FROM recs r LEFT JOIN (SELECT * FROM spikes WHERE value > 300) s ON r.rec = s.rec GROUP BY r.rec")
def silent_recordings(spark, d):
    return ev.has_events(views.spikes(spark, d).filter("value > 300"), views.recordings(spark, d))


@query("mean_gap", "SELECT rec, ch, round(avg(g), 5) AS mean_isi, count(g) AS n FROM (SELECT rec, ch, t - lag(t) OVER (PARTITION BY rec, ch ORDER BY t) AS g FROM spikes) GROUP BY rec, ch")
def mean_gap(spark, d):
    return ev.gaps(views.spikes(spark, d)).groupBy("rec", "ch").agg(r(F.avg("isi"), 5).alias("mean_isi"), F.count("isi").alias("n"))


@query("burst_criteria", """WITH a AS (SELECT rec, ch, t, t - lag(t, 2) OVER (PARTITION BY rec, ch ORDER BY t) AS span FROM spikes),
    b AS (SELECT rec, ch, max(CASE WHEN span <= 7200 THEN 1 ELSE 0 END) OVER (PARTITION BY rec, ch ORDER BY t ROWS BETWEEN CURRENT ROW AND 2 FOLLOWING) AS crit FROM a)
    SELECT rec, ch, sum(crit)::BIGINT AS n FROM b GROUP BY rec, ch""")
def burst_criteria(spark, d):
    return ev.burst_criteria(views.spikes(spark, d), 3, 7200.0).groupBy("rec", "ch").agg(F.sum(F.col("crit").cast("long")).alias("n"))


@query("channel_bursts")
def channel_bursts(spark, d):
    s, rec = views.spikes(spark, d), views.recordings(spark, d)
    return _rounded(ev.channel_burst_summary(s, ev.bursts(s, 3, 7200.0), rec), 9)


@query("array_bursts")
def array_bursts(spark, d):
    s, rec = views.spikes(spark, d), views.recordings(spark, d)
    return _rounded(ev.array_bursts(s, ev.bursts(s, 3, 7200.0), rec), 9)


@query("network_bursts")
def network_bursts(spark, d):
    return _rounded(ev.network_bursts(views.spikes(spark, d), 5, 1800.0, 3))


@query("network_burst_summary")
def network_burst_summary(spark, d):
    s, rec = views.spikes(spark, d), views.recordings(spark, d)
    return _rounded(ev.burst_summary(s, ev.network_bursts(s, 5, 1800.0, 3), rec), 9)


@query("gap_threshold")
def gap_threshold(spark, d):
    return ev.automatic_gap_threshold(views.spikes(spark, d).withColumn("t", F.col("t") / 1e5), 3)


@query("zscore_bursts")
def zscore_bursts(spark, d):
    return _rounded(ev.zscore_bursts(views.spikes(spark, d), views.channels(spark, d), views.recordings(spark, d), 3600.0, 1.0))


@query("status_runs", """WITH o AS (SELECT o_custkey, o_orderstatus AS s, row_number() OVER w - 1 AS i, lag(o_orderstatus) OVER w AS p FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)),
    g AS (SELECT *, sum(CASE WHEN p IS NULL OR p <> s THEN 1 ELSE 0 END) OVER (PARTITION BY o_custkey ORDER BY i) AS run FROM o)
    SELECT o_custkey, s AS o_orderstatus, min(i) AS start, count(*) AS length FROM g GROUP BY o_custkey, run, s""")
def status_runs(spark, d):
    return ev.runs(views.table(spark, d, "orders"), ["o_custkey"], ["o_orderdate", "o_orderkey"], "o_orderstatus")


@query("value_zscore", "SELECT event_id, round((value - avg(value) OVER w) / stddev_pop(value) OVER w, 6) AS z FROM events WINDOW w AS (PARTITION BY event_type)")
def value_zscore(spark, d):
    return ev.zscore(views.table(spark, d, "events"), ["event_type"], "value").select("event_id", r("z").alias("z"))


@query("hourly_counts", "SELECT rec, ch, floor(t / 3600)::BIGINT AS bin, count(*) AS n FROM spikes GROUP BY ALL")
def hourly_counts(spark, d):
    return ev.binned(views.spikes(spark, d), 3600.0)


@query("value_histogram", """WITH g AS (SELECT rec, unnest(range(20)) AS bin FROM recs), h AS (SELECT rec, least(floor(value / 25.0), 19)::INT AS bin, count(*) AS n FROM spikes WHERE value BETWEEN 0 AND 500 GROUP BY ALL)
    SELECT g.rec, g.bin, coalesce(n, 0) AS n FROM g LEFT JOIN h ON g.rec = h.rec AND g.bin = h.bin""")
def value_histogram(spark, d):
    return ev.histogram(views.spikes(spark, d), ["rec"], "value", 0.0, 500.0, 20)


@query("frame_bins", "SELECT rec, roi, floor(frame / 33)::BIGINT AS bin, round(avg(f), 6) AS f FROM frames GROUP BY rec, roi, floor(frame / 33) HAVING count(*) = 33")
def frame_bins(spark, d):
    return _rounded(ev.frame_bins(views.frames(spark, d).withColumn("rec", F.col("rec")), 1000.0, 33.3))


@query("top_by_value", """WITH a AS (SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC) AS rn, floor(count(*) OVER (PARTITION BY event_type) * 0.1 + 0.5) AS k FROM events),
    c AS (SELECT event_type, max(value) AS cut FROM a WHERE rn = k GROUP BY event_type) SELECT event_id, value FROM a JOIN c USING (event_type) WHERE value >= cut""")
def top_by_value(spark, d):
    return ev.top_share_by_value(views.table(spark, d, "events"), ["event_type"], "value").select("event_id", "value")


@query("refractory_events", """WITH RECURSIVE f AS (SELECT rec, ch, floor(t)::BIGINT AS frame FROM spikes GROUP BY ALL), k AS (
    SELECT rec, ch, min(frame) AS frame FROM f GROUP BY rec, ch UNION ALL
    SELECT k.rec, k.ch, (SELECT min(f.frame) FROM f WHERE f.rec = k.rec AND f.ch = k.ch AND f.frame > k.frame + 20000) FROM k WHERE k.frame IS NOT NULL)
    SELECT rec, ch, count(frame) AS n, sum(frame)::BIGINT AS total FROM k WHERE frame IS NOT NULL GROUP BY rec, ch""")
def refractory_events(spark, d):
    f = views.spikes(spark, d).select("rec", "ch", F.floor("t").alias("frame")).distinct()
    return ev.refractory(f, 20000).groupBy("rec", "ch").agg(F.count(F.lit(1)).alias("n"), F.sum("frame").alias("total"))


@query("merged_methods", "SELECT rec, count(*) AS n FROM (SELECT DISTINCT rec, ch, floor(t / 600) AS t FROM spikes) GROUP BY rec")
def merged_methods(spark, d):
    s = views.spikes(spark, d).select("rec", "ch", F.floor(F.col("t") / 600).alias("t"), F.when(F.col("value") > 50, "a").otherwise("b").alias("method"))
    return ev.merged_methods(s).groupBy("rec").agg(F.count(F.lit(1)).alias("n"))


@query("method_overlap", """WITH m AS (SELECT rec, ch, floor(t / 3600) AS b, CASE WHEN value > 50 THEN 'a' ELSE 'b' END AS m FROM spikes),
    k AS (SELECT rec, ch, b, count(DISTINCT m) AS k, min(m) AS m FROM m GROUP BY rec, ch, b) SELECT rec, CASE WHEN k > 1 THEN 'shared' ELSE m END AS method, count(*) AS n FROM k GROUP BY ALL""")
def method_overlap(spark, d):
    s = views.spikes(spark, d).select("rec", "ch", F.floor(F.col("t") / 3600).alias("t"), F.when(F.col("value") > 50, "a").otherwise("b").alias("method"))
    return ev.method_overlap(s)


@query("subjects_at_every_age", """SELECT o_custkey FROM (SELECT o_custkey, count(DISTINCT o_orderpriority) AS n FROM orders GROUP BY o_custkey)
    WHERE n = (SELECT count(DISTINCT o_orderpriority) FROM orders)""")
def subjects_at_every_age(spark, d):
    return ev.in_every_age(views.table(spark, d, "orders"), "o_custkey", "o_orderpriority")


@query("modal_status", """WITH n AS (SELECT o_custkey, o_orderstatus, count(*) AS n FROM orders GROUP BY ALL)
    SELECT o_custkey, min(o_orderstatus) AS o_orderstatus FROM n WHERE n = (SELECT max(n) FROM n m WHERE m.o_custkey = n.o_custkey) GROUP BY o_custkey""")
def modal_status(spark, d):
    return ev.mode(views.table(spark, d, "orders"), ["o_custkey"], "o_orderstatus")


# ---- joins ----------------------------------------------------------------------------------------------------------------------------

_STIM = "stim AS (SELECT rec, t AS ts, row_number() OVER (PARTITION BY rec ORDER BY t) AS trial FROM spikes WHERE ch = 0)"


def _stim(spark, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("rec").orderBy("t")
    return views.spikes(spark, d).filter("ch = 0").select("rec", F.lit(1).alias("pattern"), F.row_number().over(w).alias("trial"), F.col("t").alias("ts"))


@query("events_within_window", f"WITH {_STIM} SELECT stim.rec, trial, count(*) AS n FROM stim JOIN spikes s ON s.rec = stim.rec AND s.t BETWEEN ts - 1800 AND ts + 3600 GROUP BY stim.rec, trial")
def events_within_window(spark, d):
    return stimulus.around(views.spikes(spark, d), _stim(spark, d), -1800.0, 3600.0).groupBy("rec", "trial").agg(F.count(F.lit(1)).alias("n"))


@query("pre_post_counts", f"""WITH {_STIM}, g AS (SELECT stim.rec, trial, ts, c.ch FROM stim JOIN chans c ON c.rec = stim.rec)
    SELECT g.rec, trial, g.ch, count(*) FILTER (s.t - ts >= -7200 AND s.t - ts < 0) AS pre, count(*) FILTER (s.t - ts >= 1 AND s.t - ts < 7201) AS post
    FROM g LEFT JOIN spikes s ON s.rec = g.rec AND s.ch = g.ch AND s.t BETWEEN ts - 7200 AND ts + 7201 GROUP BY g.rec, trial, g.ch""")
def pre_post_counts(spark, d):
    return stimulus.pre_post_counts(views.spikes(spark, d), _stim(spark, d), views.channels(spark, d), (-7200.0, 0.0), (1.0, 7201.0)).drop("pattern")


@query("first_latency", f"""WITH {_STIM}, g AS (SELECT stim.rec, trial, ts, c.ch FROM stim JOIN chans c ON c.rec = stim.rec)
    SELECT g.rec, trial, g.ch, round(min(s.t - ts) * 1000, 3) AS latency_ms FROM g LEFT JOIN spikes s ON s.rec = g.rec AND s.ch = g.ch AND s.t > ts AND s.t - ts <= 14400 GROUP BY g.rec, trial, g.ch""")
def first_latency(spark, d):
    return _rounded(stimulus.first_latency(views.spikes(spark, d), _stim(spark, d), views.channels(spark, d), 14400.0).drop("pattern"), 3)


@query("trial_proportion", f"""WITH {_STIM}, g AS (SELECT stim.rec, trial, ts, c.ch FROM stim JOIN chans c ON c.rec = stim.rec),
    n AS (SELECT g.rec, trial, g.ch, count(*) FILTER (s.t - ts >= -7200 AND s.t - ts < 0) AS pre, count(*) FILTER (s.t - ts >= 1 AND s.t - ts < 7201) AS post
    FROM g LEFT JOIN spikes s ON s.rec = g.rec AND s.ch = g.ch AND s.t BETWEEN ts - 7200 AND ts + 7201 GROUP BY g.rec, trial, g.ch)
    SELECT rec, ch, round(avg(CASE WHEN post > pre THEN 1.0 ELSE 0 END), 6) AS proportion FROM n GROUP BY rec, ch""")
def trial_proportion(spark, d):
    n = stimulus.pre_post_counts(views.spikes(spark, d), _stim(spark, d), views.channels(spark, d), (-7200.0, 0.0), (1.0, 7201.0))
    return _rounded(stimulus.trial_proportion(n, ("rec", "ch")))


@query("response_indices", f"""WITH {_STIM}, g AS (SELECT stim.rec, trial, ts, c.ch FROM stim JOIN chans c ON c.rec = stim.rec),
    n AS (SELECT g.rec, trial, g.ch, count(*) FILTER (s.t - ts >= -7200 AND s.t - ts < 0) / 7200.0 AS pre, count(*) FILTER (s.t - ts >= 0 AND s.t - ts < 7200) / 7200.0 AS post, min(s.t - ts) FILTER (s.t > ts AND s.t - ts <= 7200) * 1000 AS lat
    FROM g LEFT JOIN spikes s ON s.rec = g.rec AND s.ch = g.ch AND s.t BETWEEN ts - 7200 AND ts + 7200 GROUP BY g.rec, trial, g.ch),
    a AS (SELECT rec, ch, avg(pre) AS mb, avg(post) AS mp, stddev_samp(pre) AS sb, stddev_samp(post) AS sp, quantile_cont(lat, 0.5) AS lat FROM n GROUP BY rec, ch)
    SELECT rec, ch, round(CASE WHEN sb = 0 AND sp = 0 THEN abs(mp - mb) ELSE (mp - mb) / sqrt((sb * sb + sp * sp) / 2) END, 6) AS d_prime,
    round((mp - mb) / CASE WHEN sb = 0 THEN 2.220446049250313e-16 ELSE sb END, 6) AS z, round(lat, 3) AS median_latency_ms FROM a""")
def response_indices(spark, d):
    x = stimulus.response_rows(views.spikes(spark, d), _stim(spark, d), views.channels(spark, d), 7200.0)
    return x.select("rec", "ch", r("d_prime").alias("d_prime"), r("z").alias("z"), r("median_latency_ms", 3).alias("median_latency_ms"))


@query("last_stimulus_before", f"WITH {_STIM} SELECT s.rec, s.ch, round(s.t, 6) AS t, round((SELECT max(ts) FROM stim WHERE stim.rec = s.rec AND stim.ts < s.t), 6) AS ts FROM spikes s")
def last_stimulus_before(spark, d):
    s = views.spikes(spark, d).select("rec", "ch", "t")
    return _rounded(joins.as_of(s, _stim(spark, d).select("rec", F.col("ts").alias("t"), "ts"), ["rec"], "ts"))


@query("next_stimulus_after", f"WITH {_STIM} SELECT s.rec, s.ch, round(s.t, 6) AS t, round((SELECT min(ts) FROM stim WHERE stim.rec = s.rec AND stim.ts > s.t), 6) AS ts FROM spikes s")
def next_stimulus_after(spark, d):
    s = views.spikes(spark, d).select("rec", "ch", "t")
    return _rounded(joins.as_of(s, _stim(spark, d).select("rec", F.col("ts").alias("t"), "ts"), ["rec"], "ts", forward=True))


@query("outside_blanks", f"WITH {_STIM} SELECT s.rec, s.ch, count(*) AS n FROM spikes s WHERE s.ch <> 0 AND NOT EXISTS (SELECT 1 FROM stim WHERE stim.rec = s.rec AND s.t BETWEEN ts AND ts + 5400) GROUP BY s.rec, s.ch")
def outside_blanks(spark, d):
    blanks = _stim(spark, d).select("rec", F.col("ts").alias("t0"), (F.col("ts") + 5400).alias("t1"))
    s = views.spikes(spark, d).filter("ch <> 0")
    return joins.outside_intervals(s, blanks, ["rec"]).groupBy("rec", "ch").agg(F.count(F.lit(1)).alias("n"))


@query("incremental_status", """WITH w AS (SELECT DISTINCT c_custkey AS k FROM customer WHERE c_custkey % 7 <> 1), dn AS (SELECT DISTINCT o_custkey AS k FROM orders WHERE o_orderstatus = 'P')
    SELECT k, CASE WHEN k IN (SELECT k FROM dn) THEN 'done' ELSE 'missing' END AS status FROM w UNION ALL SELECT k, 'stale' FROM dn WHERE k NOT IN (SELECT k FROM w)""")
def incremental_status(spark, d):
    w = views.table(spark, d, "customer").filter("c_custkey % 7 <> 1").select(F.col("c_custkey").alias("k"))
    return joins.new_and_missing(w, views.table(spark, d, "orders").filter("o_orderstatus = 'P'").select(F.col("o_custkey").alias("k")), "k")


@query("first_root", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) = 1")
def first_root(spark, d):
    return joins.first_root(views.table(spark, d, "orders"), "o_custkey", "o_orderkey").select("o_custkey", "o_orderkey")


@query("roster_join", """SELECT r_name AS grp, n_name AS rec, count(c_custkey) AS n, round(avg(c_acctbal), 6) AS mean_value FROM nation JOIN region ON n_regionkey = r_regionkey
    LEFT JOIN customer ON c_nationkey = n_nationkey GROUP BY ALL""")
def roster_join(spark, d):
    n = views.table(spark, d, "nation").join(views.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = views.table(spark, d, "customer").groupBy("c_nationkey").agg(F.count(F.lit(1)).alias("n"), F.sum("c_acctbal").alias("s"))
    return n.join(c, F.col("c_nationkey") == F.col("n_nationkey"), "left").select(F.col("r_name").alias("grp"), F.col("n_name").alias("rec"), F.coalesce("n", F.lit(0)).alias("n"), r(F.col("s") / F.col("n")).alias("mean_value"))


# ---- connectivity ---------------------------------------------------------------------------------------------------------------------

@query("sttc_edges", _TILING + " SELECT rec, src, dst, round(w, 6) AS w FROM tiling WHERE w > 0")
def sttc_edges(spark, d):
    s = views.spikes(spark, d).select("rec", "ch", "t").distinct()
    return _rounded(conn.sttc(s, views.recordings(spark, d), 1800.0))


@query("significant_edges")
def significant_edges(spark, d):
    s = views.spikes(spark, d).select("rec", "ch", "t").distinct()
    return _rounded(conn.significant_edges(s, views.recordings(spark, d), 1800.0, fs=1.0))


@query("threshold_stability")
def threshold_stability(spark, d):
    s, rec = views.spikes(spark, d).select("rec", "ch", "t").distinct(), views.recordings(spark, d)
    return _rounded(conn.threshold_checkpoints(conn.surrogate_weights(s, rec, 1800.0, 200, 1.0), 200, 0.05))


@query("frame_correlations", """SELECT a.rec, a.roi AS src, b.roi AS dst, round(corr(a.f, b.f), 6) AS w FROM frames a JOIN frames b ON a.rec = b.rec AND a.frame = b.frame AND a.roi < b.roi GROUP BY ALL""")
def frame_correlations(spark, d):
    return _rounded(conn.correlations(views.frames(spark, d)))


@query("strongest_edges", "SELECT rec, src, dst, w FROM edges QUALIFY row_number() OVER (PARTITION BY rec ORDER BY abs(w) DESC, src, dst) <= 50")
def strongest_edges(spark, d):
    return conn.strongest(views.supplier_edges(spark, d), KEY, 50)


@query("proportional_edges", """WITH n AS (SELECT rec, count(*) AS n FROM deg GROUP BY rec)
    SELECT rec, src, dst, w FROM edges JOIN n USING (rec) QUALIFY row_number() OVER (PARTITION BY rec ORDER BY w DESC, src, dst) <= round(0.1 * n * (n - 1) / 2)""")
def proportional_edges(spark, d):
    e = views.supplier_edges(spark, d)
    return conn.proportional(e, network.degrees(e, KEY).select("rec", "node"), KEY, 0.1)


@query("weight_percentile_cut", """WITH n AS (SELECT rec, count(*) AS n FROM deg GROUP BY rec), z AS (SELECT rec, w FROM sym UNION ALL SELECT rec, 0 FROM
    (SELECT rec, unnest(range(n * n - m)) FROM n JOIN (SELECT rec, count(*) AS m FROM sym GROUP BY rec) USING (rec)))
    SELECT rec, round(quantile_cont(w, 0.9), 6) AS cut FROM z GROUP BY rec""")
def weight_percentile_cut(spark, d):
    e = views.supplier_edges(spark, d)
    return _rounded(conn.percentile_cut(e, network.degrees(e, KEY).select("rec", "node"), KEY, 0.9))


@query("edge_percentile_cut", "SELECT rec, round(quantile_cont(w, 0.95), 6) AS cut FROM edges GROUP BY rec")
def edge_percentile_cut(spark, d):
    e = views.supplier_edges(spark, d)
    return _rounded(conn.percentile_cut(e, network.degrees(e, KEY), KEY, 0.95, of_all_entries=False))


@query("normalised_weights", "SELECT rec, src, dst, round(w / max(w) OVER (PARTITION BY rec), 6) AS w FROM edges")
def normalised_weights(spark, d):
    return _rounded(conn.normalise(views.supplier_edges(spark, d), KEY))


# ---- network metrics --------------------------------------------------------------------------------------------------------------------


@query("node_degrees", "SELECT rec, src AS node, count(*) AS degree, sum(w) AS strength, round(avg(w), 6) AS mean_weight FROM sym GROUP BY rec, src")
def node_degrees(spark, d):
    return network.degrees(views.supplier_edges(spark, d), KEY).withColumn("mean_weight", r("mean_weight"))


@query("network_density", "WITH n AS (SELECT rec, count(*) AS n FROM deg GROUP BY rec), m AS (SELECT rec, count(*) AS m FROM edges GROUP BY rec) SELECT rec, n, m, round(m / (n * (n - 1) / 2), 6) AS density FROM n JOIN m USING (rec)")
def network_density(spark, d):
    e = views.supplier_edges(spark, d)
    return _rounded(network.density(e, network.degrees(e, KEY), KEY))


@query("degree_tails", """WITH q AS (SELECT rec, quantile_cont(k, 0.75) AS p75, quantile_cont(k, 0.9) AS p90, quantile_cont(k, 0.1) AS p10 FROM deg GROUP BY rec)
    SELECT rec, round(avg(k), 6) AS mean, round(avg(k) FILTER (k >= p75), 6) AS top25, round(avg(k) FILTER (k >= p90), 6) AS top10, round(avg(k) FILTER (k <= p10), 6) AS bottom10 FROM deg JOIN q USING (rec) GROUP BY rec""")
def degree_tails(spark, d):
    return _rounded(network.tail_means(network.degrees(views.supplier_edges(spark, d), KEY), KEY, "degree"))


_TRI = "tri AS (SELECT a.rec, a.src AS x, a.dst AS y, b.dst AS z, cbrt(a.w * b.w * c.w) AS v FROM edges a JOIN edges b ON a.rec = b.rec AND a.dst = b.src JOIN edges c ON c.rec = a.rec AND c.src = a.src AND c.dst = b.dst)"


@query("clustering", f"""WITH {_TRI}, s AS (SELECT rec, n AS node, sum(v) AS s FROM (SELECT rec, x AS n, v FROM tri UNION ALL SELECT rec, y, v FROM tri UNION ALL SELECT rec, z, v FROM tri) GROUP BY rec, n)
    SELECT rec, node, round(coalesce(2 * s.s / (k * (k - 1)), 0), 6) AS cc FROM deg LEFT JOIN s USING (rec, node)""")
def clustering(spark, d):
    return _rounded(network.clustering(views.supplier_edges(spark, d), KEY))


@query("transitivity", f"WITH {_TRI}, t AS (SELECT rec, count(*) AS t FROM tri GROUP BY rec), q AS (SELECT rec, sum(k * (k - 1)) AS q FROM deg GROUP BY rec) SELECT rec, round(6.0 * coalesce(t, 0) / q, 6) AS transitivity FROM q LEFT JOIN t USING (rec)")
def transitivity(spark, d):
    return _rounded(network.transitivity(views.supplier_edges(spark, d), KEY))


@query("participation", """WITH m AS (SELECT sym.rec, src, community, sum(w) AS k FROM sym JOIN comm ON comm.rec = sym.rec AND comm.node = dst GROUP BY ALL)
    SELECT rec, src AS node, round(1 - sum(k * k) / (sum(k) * sum(k)), 6) AS pc FROM m GROUP BY rec, src""")
def participation(spark, d):
    e = views.supplier_edges(spark, d)
    return _rounded(network.participation(e, _communities(e), KEY))


def _communities(e: DataFrame) -> DataFrame:
    return network.degrees(e, KEY).select("rec", "node", (F.col("node") % 5).alias("community"))


@query("module_zscore", """WITH i AS (SELECT sym.rec, src AS node, sum(w) AS k FROM sym JOIN comm a ON a.rec = sym.rec AND a.node = src JOIN comm b ON b.rec = sym.rec AND b.node = dst WHERE a.community = b.community GROUP BY ALL),
    k AS (SELECT rec, node, community, coalesce(i.k, 0) AS k FROM comm LEFT JOIN i USING (rec, node))
    SELECT rec, node, round(CASE WHEN stddev_samp(k) OVER w > 0 THEN (k - avg(k) OVER w) / stddev_samp(k) OVER w ELSE 0 END, 6) AS z FROM k WINDOW w AS (PARTITION BY rec, community)""")
def module_zscore(spark, d):
    e = views.supplier_edges(spark, d)
    return _rounded(network.module_zscore(e, _communities(e), KEY))


@query("modularity", """WITH i AS (SELECT sym.rec, sum(w) AS i FROM sym JOIN comm a ON a.rec = sym.rec AND a.node = src JOIN comm b ON b.rec = sym.rec AND b.node = dst WHERE a.community = b.community GROUP BY ALL),
    c AS (SELECT rec, community, sum(s) AS kc FROM comm JOIN deg USING (rec, node) GROUP BY ALL), q AS (SELECT rec, sum(kc * kc) AS sq, sum(kc) AS t FROM c GROUP BY rec)
    SELECT rec, round(coalesce(i, 0) / t - sq / (t * t), 6) AS q FROM q LEFT JOIN i USING (rec)""")
def modularity(spark, d):
    e = views.supplier_edges(spark, d)
    return _rounded(network.modularity(e, _communities(e), KEY))


@query("node_roles", """WITH m AS (SELECT sym.rec, src, community, sum(w) AS k FROM sym JOIN comm ON comm.rec = sym.rec AND comm.node = dst GROUP BY ALL),
    pc AS (SELECT rec, src AS node, 1 - sum(k * k) / (sum(k) * sum(k)) AS pc FROM m GROUP BY rec, src),
    z AS (SELECT rec, node, (s - avg(s) OVER (PARTITION BY rec)) / stddev_samp(s) OVER (PARTITION BY rec) AS z FROM deg)
    SELECT rec, CASE WHEN z <= 2.5 AND pc <= 0.625 THEN 1 WHEN z <= 2.5 AND pc <= 0.8 THEN 2 WHEN z <= 2.5 THEN 3 WHEN pc <= 0.3 THEN 4 WHEN pc <= 0.75 THEN 5 ELSE 6 END AS role, count(*) AS n
    FROM pc JOIN z USING (rec, node) GROUP BY ALL""")
def node_roles(spark, d):
    from pyspark.sql import Window

    e = views.supplier_edges(spark, d)
    w = Window.partitionBy("rec")
    z = network.degrees(e, KEY).select("rec", "node", ((F.col("strength") - F.avg("strength").over(w)) / F.stddev_samp("strength").over(w)).alias("z"))
    return network.roles(network.participation(e, _communities(e), KEY).join(z, ["rec", "node"])).groupBy("rec", "role").agg(F.count(F.lit(1)).alias("n"))


@query("hub_share", """WITH r1 AS (SELECT rec, node, k, s, row_number() OVER (PARTITION BY rec ORDER BY k DESC, node) AS a, row_number() OVER (PARTITION BY rec ORDER BY s DESC, node) AS b, floor(count(*) OVER (PARTITION BY rec) * 0.1 + 0.5) AS m FROM deg),
    c AS (SELECT rec, max(k) FILTER (a = m) AS ck, max(s) FILTER (b = m) AS cs FROM r1 GROUP BY rec) SELECT rec, round(avg(CASE WHEN k >= ck AND s >= cs THEN 1.0 ELSE 0 END), 6) AS hub_share FROM r1 JOIN c USING (rec) GROUP BY rec""")
def hub_share(spark, d):
    return _rounded(network.hubs(network.degrees(views.supplier_edges(spark, d), KEY), KEY, ["degree", "strength"], 2))


@query("rich_club", """WITH e AS (SELECT edges.rec, w, least(a.k, b.k) AS k FROM edges JOIN deg a ON a.rec = edges.rec AND a.node = src JOIN deg b ON b.rec = edges.rec AND b.node = dst),
    c AS (SELECT rec, g.k AS k, sum(w) AS wr, count(*) AS er FROM e JOIN (SELECT rec AS r, unnest(range(1, max(k) + 1)) AS k FROM e GROUP BY rec) g ON g.r = e.rec AND e.k >= g.k GROUP BY rec, g.k),
    t AS (SELECT rec, row_number() OVER v AS er, sum(w) OVER (PARTITION BY rec ORDER BY w DESC, src, dst ROWS UNBOUNDED PRECEDING) AS top FROM edges WINDOW v AS (PARTITION BY rec ORDER BY w DESC, src, dst))
    SELECT rec, k::INT AS k, round(wr / top, 6) AS rw FROM c JOIN t USING (rec, er)""")
def rich_club(spark, d):
    return _rounded(network.rich_club(views.supplier_edges(spark, d), KEY))


@query("assortativity", "SELECT sym.rec, CASE WHEN stddev_pop(a.k) > 0 THEN round(corr(a.k, b.k), 6) END AS r FROM sym JOIN deg a ON a.rec = sym.rec AND a.node = src JOIN deg b ON b.rec = sym.rec AND b.node = dst GROUP BY sym.rec")
def assortativity(spark, d):
    return _rounded(network.assortativity(views.supplier_edges(spark, d), KEY))


@query("matching_index", """WITH c AS (SELECT a.rec, a.src, b.src AS dst, count(*) AS c FROM sym a JOIN sym b ON a.rec = b.rec AND a.dst = b.dst AND a.src < b.src GROUP BY ALL)
    SELECT c.rec, c.src, c.dst, round(2 * c / (a.k + b.k - 2 * CASE WHEN e.w IS NULL THEN 0 ELSE 1 END), 6) AS m FROM c JOIN deg a ON a.rec = c.rec AND a.node = c.src JOIN deg b ON b.rec = c.rec AND b.node = c.dst
    LEFT JOIN edges e ON e.rec = c.rec AND e.src = c.src AND e.dst = c.dst""")
def matching_index(spark, d):
    return _rounded(network.matching_index(views.supplier_edges(spark, d), KEY))


@query("topological_overlap", """WITH c AS (SELECT a.rec, a.src, b.src AS dst, count(*) AS c FROM sym a JOIN sym b ON a.rec = b.rec AND a.dst = b.dst AND a.src < b.src GROUP BY ALL),
    p AS (SELECT rec, src, dst, coalesce(c, 0) AS c, CASE WHEN w IS NULL THEN 0 ELSE 1 END AS a FROM c FULL JOIN edges USING (rec, src, dst))
    SELECT p.rec, p.src, p.dst, round((c + p.a) / (least(x.k, y.k) + 1 - p.a), 6) AS o FROM p JOIN deg x ON x.rec = p.rec AND x.node = p.src JOIN deg y ON y.rec = p.rec AND y.node = p.dst""")
def topological_overlap(spark, d):
    return _rounded(network.topological_overlap(views.supplier_edges(spark, d), KEY))


@query("neighbour_overlap", """WITH c AS (SELECT e.rec, e.src, e.dst, count(*) AS c FROM edges e JOIN sym a ON a.rec = e.rec AND a.src = e.src JOIN sym b ON b.rec = e.rec AND b.src = e.dst AND b.dst = a.dst GROUP BY ALL)
    SELECT e.rec, e.src, e.dst, round(CASE WHEN x.k + y.k - 2 - coalesce(c, 0) > 0 THEN coalesce(c, 0) / (x.k + y.k - 2 - coalesce(c, 0)) ELSE 0 END, 6) AS o
    FROM edges e LEFT JOIN c USING (rec, src, dst) JOIN deg x ON x.rec = e.rec AND x.node = e.src JOIN deg y ON y.rec = e.rec AND y.node = e.dst""")
def neighbour_overlap(spark, d):
    return _rounded(network.neighbour_overlap(views.supplier_edges(spark, d), KEY))


@query("group_subnetworks", "SELECT edges.rec, a.community AS cell_group, count(*) AS n, sum(w) AS w FROM edges JOIN comm a ON a.rec = edges.rec AND a.node = src JOIN comm b ON b.rec = edges.rec AND b.node = dst WHERE a.community = b.community GROUP BY ALL")
def group_subnetworks(spark, d):
    e = views.supplier_edges(spark, d)
    m = _communities(e).select("rec", F.col("node").alias("ch"), F.col("community").alias("cell_group"))
    return network.induced(e, m, KEY).groupBy("rec", "cell_group").agg(F.count(F.lit(1)).alias("n"), F.sum("w").alias("w"))


@query("edge_mixing", """WITH f AS (SELECT edges.rec, least(a.community, b.community) AS group_a, greatest(a.community, b.community) AS group_b, count(*) AS n_edges, avg(w) AS m FROM edges JOIN comm a ON a.rec = edges.rec AND a.node = src JOIN comm b ON b.rec = edges.rec AND b.node = dst GROUP BY ALL),
    z AS (SELECT rec, community, count(*) AS n FROM comm GROUP BY ALL)
    SELECT a.rec, a.community AS group_a, b.community AS group_b, (CASE WHEN a.community = b.community THEN a.n * (a.n - 1) / 2 ELSE a.n * b.n END)::BIGINT AS n_possible, coalesce(n_edges, 0) AS n_edges, round(m, 6) AS mean_weight
    FROM z a JOIN z b ON a.rec = b.rec AND a.community <= b.community LEFT JOIN f ON f.rec = a.rec AND f.group_a = a.community AND f.group_b = b.community""")
def edge_mixing(spark, d):
    e = views.supplier_edges(spark, d)
    return _rounded(network.edge_mixing(e, _communities(e).select("rec", F.col("node").alias("ch"), F.col("community").alias("cell_group")), KEY))


@query("within_group_strength", """WITH i AS (SELECT sym.rec, a.community, src AS node, sum(w) AS i FROM sym JOIN comm a ON a.rec = sym.rec AND a.node = src JOIN comm b ON b.rec = sym.rec AND b.node = dst WHERE a.community = b.community GROUP BY ALL)
    SELECT rec, community AS cell_group, node, round(coalesce(i, 0) / s, 6) AS share FROM comm JOIN deg USING (rec, node) LEFT JOIN i USING (rec, community, node)""")
def within_group_strength(spark, d):
    e = views.supplier_edges(spark, d)
    return _rounded(network.within_group_strength(e, _communities(e).select("rec", F.col("node").alias("ch"), F.col("community").alias("cell_group")), KEY))


_PATHS = """WITH RECURSIVE hop AS (SELECT rec, src, dst, 1 / w AS d, 1 AS n FROM sym), two AS (SELECT rec, src, dst, min(d) AS d FROM (SELECT rec, src, dst, d FROM hop UNION ALL
    SELECT a.rec, a.src, b.dst, a.d + b.d FROM hop a JOIN hop b ON a.rec = b.rec AND a.dst = b.src AND a.src <> b.dst) GROUP BY ALL),
    four AS (SELECT rec, src, dst, min(d) AS d FROM (SELECT rec, src, dst, d FROM two UNION ALL SELECT a.rec, a.src, b.dst, a.d + b.d FROM two a JOIN two b ON a.rec = b.rec AND a.dst = b.src AND a.src <> b.dst) GROUP BY ALL),
    paths AS (SELECT rec, src, dst, min(d) AS d FROM (SELECT rec, src, dst, d FROM four UNION ALL SELECT a.rec, a.src, b.dst, a.d + b.d FROM four a JOIN four b ON a.rec = b.rec AND a.dst = b.src AND a.src <> b.dst) GROUP BY ALL)"""


@query("path_metrics", _PATHS.replace("WITH RECURSIVE", "WITH") + ", n AS (SELECT rec, count(*) AS n FROM deg GROUP BY rec) SELECT rec, round(avg(d), 6) AS path_length, round(sum(1 / d) / any_value(n * n - n), 6) AS global_efficiency FROM paths JOIN n USING (rec) GROUP BY rec")
def path_metrics(spark, d):
    e = cut(views.supplier_edges(spark, d))  # read twice
    return _rounded(network.path_metrics(network.path_sums(e, KEY), network.degrees(e, KEY), KEY))


@query("nodal_efficiency", _PATHS.replace("WITH RECURSIVE", "WITH") + ", n AS (SELECT rec, count(*) AS n FROM deg GROUP BY rec), q AS (SELECT rec, src AS node, sum(d) AS far, count(*) AS reached FROM paths GROUP BY ALL) SELECT deg.rec, deg.node, round(CASE WHEN reached = n - 1 THEN n / far ELSE 0 END, 6) AS ne FROM deg JOIN n USING (rec) LEFT JOIN q ON q.rec = deg.rec AND q.node = deg.node")
def nodal_efficiency(spark, d):
    e = cut(views.supplier_edges(spark, d))  # read twice
    return _rounded(network.nodal_efficiency(network.path_sums(e, KEY), network.degrees(e, KEY).select("rec", "node"), KEY))


def tiling_network(spark, d) -> DataFrame:
    """Every recording's channels joined by positive tiling coefficients: networks of an instrument's size, one for each recording."""
    return cut(conn.sttc(views.spikes(spark, d).select("rec", "ch", "t").distinct(), views.recordings(spark, d), 1800.0))  # metrics read it many times


@query("components", """WITH RECURSIVE s AS (SELECT rec, src, dst FROM netsym),
    reach AS (SELECT rec, src AS node, src AS seen FROM s UNION SELECT reach.rec, reach.node, s.dst FROM reach JOIN s ON s.rec = reach.rec AND s.src = reach.seen)
    SELECT rec, node, min(seen) AS component FROM reach GROUP BY rec, node""")
def components(spark, d):
    return network.components(tiling_network(spark, d), KEY)


@query("k_core")
def k_core(spark, d):
    return network.k_core(tiling_network(spark, d), KEY, 5)


@query("coreness")
def coreness(spark, d):
    return network.coreness(tiling_network(spark, d), KEY)


@query("s_core")
def s_core(spark, d):
    return _rounded(network.s_core(tiling_network(spark, d), KEY, 0.1))


@query("pagerank")
def pagerank(spark, d):
    return _rounded(network.pagerank(tiling_network(spark, d), KEY))


@query("walk_counts", "WITH s AS (SELECT rec, src, dst FROM netsym), w2 AS (SELECT a.rec, count(*) AS n FROM s a JOIN s b ON a.rec = b.rec AND a.dst = b.src GROUP BY a.rec), w3 AS (SELECT a.rec, count(*) AS n FROM s a JOIN s b ON a.rec = b.rec AND a.dst = b.src JOIN s c ON c.rec = b.rec AND b.dst = c.src GROUP BY a.rec) SELECT rec, 1 AS q, count(*) AS n FROM s GROUP BY rec UNION ALL SELECT rec, 2, n FROM w2 UNION ALL SELECT rec, 3, n FROM w3")
def walk_counts(spark, d):
    return network.walks(tiling_network(spark, d), KEY, 3)


@query("directed_degrees", """WITH n AS (SELECT rec, src AS node FROM steps UNION SELECT rec, dst FROM steps), i AS (SELECT rec, dst AS node, count(*) AS k, sum(w) AS s FROM steps GROUP BY ALL), o AS (SELECT rec, src AS node, count(*) AS k, sum(w) AS s FROM steps GROUP BY ALL)
    SELECT n.rec, n.node, coalesce(i.k, 0) AS indegree, coalesce(o.k, 0) AS outdegree, coalesce(i.s, 0) AS in_strength, coalesce(o.s, 0) AS out_strength FROM n LEFT JOIN i ON i.rec = n.rec AND i.node = n.node LEFT JOIN o ON o.rec = n.rec AND o.node = n.node""")
def directed_degrees(spark, d):
    return network.directed_degrees(steps(spark, d), KEY).select("rec", "node", "indegree", "outdegree", "in_strength", "out_strength")


def steps(spark, d) -> DataFrame:
    """Arcs from each line's supplier to that of the next line of its order, one network per return flag and year; w: how often."""
    li = views.table(spark, d, "lineitem")
    a = li.select("l_orderkey", (F.col("l_linenumber") + 1).alias("l_linenumber"), F.concat("l_returnflag", F.year("l_shipdate").cast("string")).alias("rec"), F.col("l_suppkey").alias("src"))
    b = li.select("l_orderkey", "l_linenumber", F.col("l_suppkey").alias("dst"))
    return a.join(b, ["l_orderkey", "l_linenumber"]).filter("src <> dst").groupBy("rec", "src", "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


@query("local_efficiency")
def local_efficiency(spark, d):
    return _rounded(network.local_efficiency(tiling_network(spark, d), KEY))


@query("motifs")
def motifs(spark, d):
    return network.motifs3(steps(spark, d), KEY)


@query("community_agreement")
def community_agreement(spark, d):
    e = tiling_network(spark, d)
    runs = kernels.replicated(e, 50, "run")
    return network.agreement(kernels.louvain(runs, ["rec", "run"]), KEY)


@query("louvain")
def louvain(spark, d):
    e = tiling_network(spark, d)
    return _rounded(network.modularity(e, kernels.louvain(e, KEY), KEY))


@query("consensus_communities")
def consensus_communities(spark, d):
    return kernels.consensus_communities(tiling_network(spark, d), KEY)


@query("partition_distance")
def partition_distance(spark, d):
    e = tiling_network(spark, d)
    return _rounded(network.partition_distance(kernels.louvain(e, KEY), _communities(e), KEY))


@query("betweenness")
def betweenness(spark, d):
    return _rounded(kernels.betweenness(tiling_network(spark, d), KEY))


@query("edge_betweenness")
def edge_betweenness(spark, d):
    return _rounded(kernels.edge_betweenness(tiling_network(spark, d), KEY))


@query("eigenvector_centrality")
def eigenvector_centrality(spark, d):
    return _rounded(kernels.eigenvector_centrality(tiling_network(spark, d), KEY))


@query("communicability")
def communicability(spark, d):
    return _rounded(kernels.communicability(conn.normalise(tiling_network(spark, d), KEY), KEY))


@query("controllability")
def controllability(spark, d):
    return _rounded(kernels.controllability(tiling_network(spark, d), KEY))


@query("normalised_participation")
def normalised_participation(spark, d):
    e = tiling_network(spark, d)
    return _rounded(kernels.normalised_participation(e, _communities(e), KEY))


@query("small_worldness")
def small_worldness(spark, d):
    return _rounded(kernels.small_worldness(tiling_network(spark, d), KEY))


@query("effective_rank")
def effective_rank(spark, d):
    return _rounded(kernels.effective_rank(views.frames(spark, d)))


@query("nmf_components")
def nmf_components(spark, d):
    s = ev.binned(views.spikes(spark, d), 43200.0)
    return kernels.nmf_components(s)


# ---- stimulus -----------------------------------------------------------------------------------------------------------------------------


@query("psth_metrics")
def psth_metrics(spark, d):
    c = stimulus.psth(views.spikes(spark, d), _stim(spark, d), -7200.0, 7200.0, fwhm=600.0, points=200)
    return _rounded(stimulus.psth_metrics(c, -7200.0, 7200.0, 200), 9).drop("pattern")


@query("shuffle_test")
def shuffle_test(spark, d):
    s = views.spikes(spark, d).select("rec", "ch", "t")
    return _rounded(stimulus.shuffle_test(s, _stim(spark, d), views.channels(spark, d), views.recordings(spark, d), (-7200.0, 0.0), (1.0, 7201.0), shuffles=500, fs=1.0)).drop("pattern")


@query("trial_responses", f"""WITH {_STIM}, g AS (SELECT stim.rec, trial, ts, c.ch FROM stim JOIN chans c ON c.rec = stim.rec)
    SELECT g.rec, trial, g.ch, count(s.t) AS n, round(count(s.t) / 7200.0, 9) AS rate, round(min(s.t - ts) * 1000, 3) AS latency_ms FROM g LEFT JOIN spikes s ON s.rec = g.rec AND s.ch = g.ch AND s.t > ts AND s.t - ts <= 7200 GROUP BY g.rec, trial, g.ch""")
def trial_responses(spark, d):
    x = stimulus.trial_counts(views.spikes(spark, d), _stim(spark, d), views.channels(spark, d), 7200.0)
    return x.select("rec", "trial", "ch", "n", r("rate", 9).alias("rate"), r("latency_ms", 3).alias("latency_ms"))


@query("rate_tensor", f"WITH {_STIM} SELECT stim.rec, trial, s.ch, floor((s.t - ts) / 600)::BIGINT AS bin, round(count(*) / 600.0, 9) AS rate FROM stim JOIN spikes s ON s.rec = stim.rec AND s.t >= ts AND s.t < ts + 7200 GROUP BY ALL")
def rate_tensor(spark, d):
    return _rounded(stimulus.rate_tensor(views.spikes(spark, d), _stim(spark, d), 0.0, 7200.0, 600.0), 9).drop("pattern")


@query("onset_levels", "WITH m AS (SELECT event_type AS rec, avg(value) AS mu, stddev_samp(value) AS sd FROM events GROUP BY ALL) SELECT rec, count(*) AS n FROM events JOIN m ON m.rec = event_type WHERE value > mu + 2 * sd GROUP BY rec")
def onset_levels(spark, d):
    s = views.table(spark, d, "events").select(F.col("event_type").alias("rec"), F.lit(0).alias("ch"), F.col("event_id").alias("frame"), (-F.col("value")).alias("v"))
    return stimulus.onsets_by_voltage(s, "deviation", 2.0, 0).groupBy("rec").agg(F.count(F.lit(1)).alias("n"))


# ---- signals ----------------------------------------------------------------------------------------------------------------------------


def _samples(spark, d) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("event_type").orderBy("event_id")
    return views.table(spark, d, "events").select(F.col("event_type").alias("rec"), F.lit(0).alias("ch"), (F.row_number().over(w) - 1).cast("long").alias("frame"), F.col("value").alias("v"))


@query("robust_threshold", """WITH m AS (SELECT event_type AS rec, quantile_cont(value, 0.5) AS med, avg(value) AS mu FROM events GROUP BY ALL)
    SELECT rec, 0 AS ch, round(any_value(med) - 4 * quantile_cont(abs(value - mu), 0.5) / 0.6745, 6) AS threshold FROM events JOIN m ON m.rec = event_type GROUP BY rec""")
def robust_threshold(spark, d):
    return _rounded(signal.robust_threshold(_samples(spark, d), 4.0))


@query("bandpass_power")
def bandpass_power(spark, d):
    x = signal.bandpass(_samples(spark, d), 60.0, 300.0, 1000.0, 2000)
    return _rounded(x.groupBy("rec").agg(F.avg(F.col("v") * F.col("v")).alias("power"), F.count(F.lit(1)).alias("n")), 4)


@query("wavelet_events")
def wavelet_events(spark, d):
    return signal.detect_by_wavelet(_samples(spark, d).withColumn("v", -F.col("v")), 12500.0, frames=2000).groupBy("rec").agg(F.count(F.lit(1)).alias("n"))


@query("aligned_waveforms")
def aligned_waveforms(spark, d):
    s = _samples(spark, d).withColumn("v", -F.col("v"))
    e = s.filter("v < -150").select("rec", "ch", "frame")
    return _rounded(signal.median_waveform(signal.align_peaks(e, s, bounds=(-1.0, -100.0, 15.0)), ["rec"]))


@query("spike_templates")
def spike_templates(spark, d):
    s = _samples(spark, d).withColumn("v", -F.col("v"))
    w = signal.align_peaks(s.filter("v < -150").select("rec", "ch", "frame"), s, bounds=(-1.0, -100.0, 15.0))
    return _rounded(templates.spike_templates(templates.spike_clusters(w, ["rec", "ch"], "shape", 12500.0, depth=0.2), ["rec", "ch"]))


@query("moving_average", "SELECT event_type AS rec, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame, round(avg(value) OVER (PARTITION BY event_type ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING), 6) AS smooth FROM events")
def moving_average(spark, d):
    return _rounded(signal.moving_average(_samples(spark, d), ["rec"], "frame", "v", 9).select("rec", "frame", "smooth"))


_P2, _P3 = "({0} * {0} - 25 * 26 / 3.0)", "({0} * {0} * {0} - {0} * (3 * 25 * 25 + 3 * 25 - 1) / 5.0)"  # discrete orthogonal polynomials on -25..25


@query("savitzky_golay", f"""WITH s AS (SELECT event_type AS rec, row_number() OVER (PARTITION BY event_type ORDER BY event_id) - 1 AS frame, value AS v, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    k AS (SELECT unnest(range(-25, 26))::DOUBLE AS k), z AS (SELECT sum(k * k) AS z1, sum({_P2.format("k")} ** 2) AS z2, sum({_P3.format("k")} ** 2) AS z3 FROM k),
    c AS (SELECT rec, frame, n, greatest(least(frame, n - 26), 25) AS mid, (frame - greatest(least(frame, n - 26), 25))::DOUBLE AS x FROM s),
    j AS (SELECT c.rec, c.frame, c.n, c.x, k.k, s.v FROM c CROSS JOIN k JOIN s ON s.rec = c.rec AND s.frame = c.mid + k.k)
    SELECT rec, frame, round(CASE WHEN n >= 51 THEN m END, 6) AS smooth FROM (SELECT rec, frame, any_value(n) AS n, sum(v * (1 / 51.0 + x * k / z1 + {_P2.format("x")} * {_P2.format("k")} / z2 + {_P3.format("x")} * {_P3.format("k")} / z3)) AS m FROM j CROSS JOIN z GROUP BY rec, frame)""")
def savitzky_golay(spark, d):
    return _rounded(signal.savitzky_golay(_samples(spark, d), ["rec"], "frame", "v", 51, 3).select("rec", "frame", "smooth"))


@query("calcium_peaks")
def calcium_peaks(spark, d):
    f = _samples(spark, d).select("rec", F.col("ch").alias("roi"), "frame", (F.col("v") + 1000).alias("f"))
    return _rounded(signal.find_peaks(signal.denoise(signal.delta_f(f), 0.05), 0.05, 0.02))


@query("hazen_percentile", """WITH a AS (SELECT event_type AS rec, value AS v, row_number() OVER (PARTITION BY event_type ORDER BY value) AS i, count(*) OVER (PARTITION BY event_type) AS n FROM events),
    p AS (SELECT *, least(greatest(0.75 * n + 0.5, 1.0), n) AS pos FROM a) SELECT rec, round(max(v) FILTER (i = floor(pos)) + (max(v) FILTER (i = ceil(pos)) - max(v) FILTER (i = floor(pos))) * max(pos - floor(pos)), 6) AS p FROM p GROUP BY rec""")
def hazen_percentile(spark, d):
    return _rounded(signal.hazen_percentile(_samples(spark, d), ["rec"], "v", 0.75))


@query("normalised_coordinates", """SELECT s_suppkey, round((s_acctbal - lo) / (hi - lo) * 8, 6) AS x, round((s_suppkey - lo) / (hi - lo) * 8, 6) AS y FROM (SELECT *, min(least(s_acctbal, s_suppkey)) OVER () AS lo, max(greatest(s_acctbal, s_suppkey)) OVER () AS hi FROM supplier)""")
def normalised_coordinates(spark, d):
    s = views.table(spark, d, "supplier").select(F.lit(1).alias("rec"), "s_suppkey", F.col("s_acctbal").alias("x"), F.col("s_suppkey").cast("double").alias("y"))
    return _rounded(signal.normalised_coordinates(s).select("s_suppkey", "x", "y"))


# ---- statistics ---------------------------------------------------------------------------------------------------------------------------


@query("anova", """WITH g AS (SELECT n_regionkey AS grp, c_mktsegment AS metric, c_acctbal AS v FROM customer JOIN nation ON c_nationkey = n_nationkey),
    m AS (SELECT metric, grp, count(*) AS n, avg(v) AS m, coalesce(var_samp(v), 0) AS s FROM g GROUP BY ALL),
    a AS (SELECT metric, sum(n) AS n, count(*) AS k, sum(n * m * m) - sum(n * m) ** 2 / sum(n) AS ssb, sum((n - 1) * s) AS ssw FROM m GROUP BY metric)
    SELECT metric, round(ssb / (k - 1) / (ssw / (n - k)), 6) AS f, (k - 1)::BIGINT AS df1, (n - k)::BIGINT AS df2 FROM a""")
def anova(spark, d):
    return _rounded(stats.anova(_metric_rows(spark, d), ["metric"]))


def _metric_rows(spark, d) -> DataFrame:
    c = views.table(spark, d, "customer").join(views.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select(F.col("c_mktsegment").alias("metric"), F.col("n_regionkey").alias("grp"), F.col("c_acctbal").alias("value"))


@query("anova_p_values")
def anova_p_values(spark, d):
    a = stats.anova(_metric_rows(spark, d), ["metric"])
    return _rounded(a.withColumn("p", stats.f_p_value(F.col("f"), F.col("df1"), F.col("df2"))))


@query("pairwise_tests", """WITH g AS (SELECT c_mktsegment AS metric, n_regionkey AS grp, count(*) AS n, avg(c_acctbal) AS m, stddev_samp(c_acctbal) AS s FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL)
    SELECT a.metric, a.grp AS group_a, b.grp AS group_b, round((a.m - b.m) / sqrt(((a.n - 1) * a.s ** 2 + (b.n - 1) * b.s ** 2) / (a.n + b.n - 2) * (1 / a.n + 1 / b.n)), 6) AS t, a.n + b.n - 2 AS df, round((b.m - a.m) / ((b.s + a.s) / 2), 6) AS d_prime
    FROM g a JOIN g b ON a.metric = b.metric AND a.grp < b.grp""")
def pairwise_tests(spark, d):
    return _rounded(stats.pairwise_tests(_metric_rows(spark, d), ["metric"]))


@query("paired_tests", """WITH s AS (SELECT o_orderstatus AS metric, o_custkey AS subject, o_orderpriority AS age, avg(o_totalprice) AS value FROM orders GROUP BY ALL),
    g AS (SELECT a.metric, a.age AS age_a, b.age AS age_b, count(*) AS n, avg(b.value - a.value) AS m, stddev_samp(b.value - a.value) AS s FROM s a JOIN s b ON a.metric = b.metric AND a.subject = b.subject AND a.age < b.age GROUP BY ALL)
    SELECT metric, age_a, age_b, round(m / (s / sqrt(n)), 6) AS t, n - 1 AS df FROM g WHERE n > 1""")
def paired_tests(spark, d):
    return _rounded(stats.paired_tests(_repeated(spark, d), ["metric"]))


def _repeated(spark, d) -> DataFrame:
    return views.table(spark, d, "orders").groupBy(F.col("o_orderstatus").alias("metric"), F.col("o_custkey").alias("subject"), F.col("o_orderpriority").alias("age")).agg(F.avg("o_totalprice").alias("value"))


@query("repeated_anova", """WITH s AS (SELECT o_orderstatus AS metric, o_custkey AS subject, o_orderpriority AS age, avg(o_totalprice) AS v FROM orders GROUP BY ALL),
    f AS (SELECT * FROM s QUALIFY count(*) OVER (PARTITION BY metric, subject) = 5), g AS (SELECT metric, avg(v) AS g, count(*) AS c, count(DISTINCT subject) AS n, var_pop(v) * count(*) AS t FROM f GROUP BY metric),
    ss AS (SELECT metric, var_pop(m) * count(*) * 5 AS s FROM (SELECT metric, subject, avg(v) AS m FROM f GROUP BY ALL) GROUP BY metric),
    sa AS (SELECT metric, var_pop(m) * count(*) * any_value(n) AS a FROM (SELECT metric, age, avg(v) AS m, count(*) AS n FROM f GROUP BY ALL) GROUP BY metric)
    SELECT metric, round(a / 4 / ((t - s - a) / (4 * (n - 1))), 5) AS f, 4::BIGINT AS df1, 4 * (n - 1) AS df2 FROM g JOIN ss USING (metric) JOIN sa USING (metric)""")
def repeated_anova(spark, d):
    return _rounded(stats.repeated_anova(_repeated(spark, d), ["metric"]), 5)


@query("mixed_model")
def mixed_model(spark, d):
    o = views.table(spark, d, "orders").select(F.col("o_orderstatus").alias("metric"), F.col("o_custkey").alias("subject"), F.substring("o_orderpriority", 1, 1).cast("int").alias("age"), (F.col("o_totalprice") / 1e5).alias("value"))
    return _rounded(stats.mixed_model(o, ["metric"]), 4)


@query("feature_correlations", """WITH w AS (SELECT l_returnflag AS rec, l_quantity AS q, l_extendedprice AS p, l_discount AS c, l_tax AS t FROM lineitem)
    SELECT rec, 'l_quantity' AS a, 'l_extendedprice' AS b, round(corr(q, p), 6) AS r FROM w GROUP BY rec UNION ALL SELECT rec, 'l_quantity', 'l_discount', round(corr(q, c), 6) FROM w GROUP BY rec
    UNION ALL SELECT rec, 'l_extendedprice', 'l_discount', round(corr(p, c), 6) FROM w GROUP BY rec""")
def feature_correlations(spark, d):
    li = views.table(spark, d, "lineitem").withColumnRenamed("l_returnflag", "rec")
    return _rounded(stats.feature_correlations(li, ["rec"], ["l_quantity", "l_extendedprice", "l_discount"]))


def _wide(spark, d, k: int = 64) -> DataFrame:
    return views.table(spark, d, "embeddings").select("label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(k)))


@query("discriminant")
def discriminant(spark, d):
    return _rounded(stats.discriminant(_wide(spark, d), "label", [f"x{i}" for i in range(64)]))


@query("classifier_losses")
def classifier_losses(spark, d):
    return _rounded(stats.classifier_losses(_wide(spark, d), "label", [f"x{i}" for i in range(64)]))


@query("kernel_density", """WITH g AS (SELECT r_name AS rec, count(*) AS n, greatest(1.06 * stddev_samp(c_acctbal) * count(*) ** -0.2, 0.1 * (max(c_acctbal) - min(c_acctbal)), 1e-9) AS h, min(c_acctbal) AS lo, max(c_acctbal) AS hi FROM c GROUP BY r_name),
    c AS (SELECT r_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), x AS (SELECT rec, n, h, unnest(range(20)) AS i, lo + (hi - lo) * i / 19 AS x FROM g)
    SELECT rec, i::INT AS i, round(x, 6) AS x, round(sum(exp(-0.5 * ((x - c_acctbal) / h) ** 2)) / (any_value(n) * any_value(h) * sqrt(2 * pi())), 9) AS density FROM x JOIN c ON r_name = rec GROUP BY rec, i, x""".replace("WITH g AS (", "WITH c AS (SELECT r_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), g AS (").replace("GROUP BY r_name),\n    c AS (SELECT r_name, c_acctbal FROM customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey), x AS", "GROUP BY r_name),\n    x AS").replace("unnest(range(20)) AS i, lo + (hi - lo) * i / 19 AS x FROM g)", "i, lo + (hi - lo) * i / 19 AS x FROM g, (SELECT unnest(range(20)) AS i))"))
def kernel_density(spark, d):
    c = views.table(spark, d, "customer").join(views.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).join(views.table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    x = stats.kernel_density(c.select(F.col("r_name").alias("rec"), F.col("c_acctbal").alias("value")), ["rec"], "value", 20)
    return x.select("rec", "i", r("x").alias("x"), r("density", 9).alias("density"))


@query("group_summary", "SELECT n_regionkey AS grp, c_mktsegment AS metric, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS sem FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL")
def group_summary(spark, d):
    return _rounded(stats.summary(_metric_rows(spark, d), ["grp", "metric"]))


@query("best_split")
def best_split(spark, d):
    return _rounded(stats.best_split(views.table(spark, d, "events"), "value"))


# ---- scalars and sources --------------------------------------------------------------------------------------------------------------------


@query("scalar_functions", """SELECT event_id, (event_id % 90)::INT || 'mslag' AS lag, round(round_even(value, 1), 1) AS even, round(value, 1) AS up, CASE WHEN (event_id % 1000) + 300 > 1000 THEN (event_id % 1000) + 300 - 1000 ELSE (event_id % 1000) + 300 END AS moved,
    """ + scalars.mixed_sql("event_id", "user_id") + " AS h FROM events")
def scalar_functions(spark, d):
    e = views.table(spark, d, "events")
    x = F.col("event_id") % 1000
    return e.select("event_id", scalars.lag_name(F.col("event_id") % 90).alias("lag"), scalars.half_even(F.col("value"), 1).alias("even"), scalars.half_up(F.col("value"), 1).alias("up"), scalars.circular_shift(x, F.lit(300), F.lit(1000)).alias("moved"), scalars.mixed(F.col("event_id"), F.col("user_id")).alias("h"))


@query("value_entropy", "WITH p AS (SELECT event_type AS rec, value / sum(value) OVER (PARTITION BY event_type) AS p FROM events) SELECT rec, round(exp(-sum(CASE WHEN p > 0 THEN p * ln(p) ELSE 0 END)), 4) AS e FROM p GROUP BY rec")
def value_entropy(spark, d):
    from pyspark.sql import Window

    e = views.table(spark, d, "events").select(F.col("event_type").alias("rec"), (F.col("value") / F.sum("value").over(Window.partitionBy("event_type"))).alias("p"))
    return e.groupBy("rec").agg(r(scalars.entropy_exp(F.col("p")), 4).alias("e"))


@query("roster_problems", """WITH r AS (SELECT p_name AS rec, p_size AS div, CASE WHEN p_partkey % 9 = 0 THEN '' ELSE p_brand END AS grp FROM part)
    SELECT 'blank_group' AS code, count(*) AS n, min(rec) AS example FROM r WHERE grp = '' UNION ALL SELECT 'group_characters', count(*), min(rec) FROM r WHERE grp <> '' AND regexp_matches(grp, '[^A-Za-z0-9_]')
    UNION ALL SELECT 'repeated_name', count(*), min(rec) FROM (SELECT rec FROM r GROUP BY rec HAVING count(*) > 1) HAVING count(*) > 0""")
def roster_problems(spark, d):
    p = views.table(spark, d, "part")
    return tables.roster_problems(p.select(F.col("p_name").alias("rec"), F.col("p_size").cast("double").alias("div"), F.when(F.col("p_partkey") % 9 == 0, "").otherwise(F.col("p_brand")).alias("grp")))


@query("metric_table", "SELECT o_custkey, max(s) FILTER (o_orderstatus = 'F') AS F, max(s) FILTER (o_orderstatus = 'O') AS O, max(s) FILTER (o_orderstatus = 'P') AS P FROM (SELECT o_custkey, o_orderstatus, round(sum(o_totalprice), 4) AS s FROM orders GROUP BY ALL) GROUP BY o_custkey")
def metric_table(spark, d):
    o = views.table(spark, d, "orders").groupBy("o_custkey", F.col("o_orderstatus").alias("metric")).agg(r(F.sum("o_totalprice"), 4).alias("value"))
    return tables.metric_table(o, ["o_custkey"], ["F", "O", "P"])


@query("cell_type_groups", """WITH m AS (SELECT s_suppkey AS roi, s_nationkey % 3 = 0 AS a, s_nationkey % 4 = 0 AS b FROM supplier)
    SELECT g AS cell_group, count(*) AS n FROM (SELECT 'both' AS g FROM m WHERE a AND b UNION ALL SELECT 'only_a' FROM m WHERE a AND NOT b UNION ALL SELECT 'any_b' FROM m WHERE b UNION ALL SELECT 'Unassigned' FROM m WHERE NOT a AND NOT b) GROUP BY g""")
def cell_type_groups(spark, d):
    s = views.table(spark, d, "supplier").select(F.lit(1).alias("rec"), F.col("s_suppkey").alias("roi"), "s_nationkey")
    m = s.filter("s_nationkey % 3 = 0").select("rec", "roi", F.lit("a").alias("marker")).unionByName(s.filter("s_nationkey % 4 = 0").select("rec", "roi", F.lit("b").alias("marker")))
    a, b = F.col("a"), F.col("b")
    return tables.cell_groups(m, s.select("rec", "roi"), {"both": a & b, "only_a": a & ~b, "any_b": b}, ["a", "b"]).groupBy("cell_group").agg(F.count(F.lit(1)).alias("n"))
