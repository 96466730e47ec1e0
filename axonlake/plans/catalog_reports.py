"""Queries of whole reports and of learning on responses."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions.iterate import cut
from ..operators import events as ev
from ..operators import connectivity, kernels, learning, mixed, neighbours, network, rate_curves, stimulus
from ..sources import views
from . import reports
from .catalog import KEY, _communities, _rounded, _stim, _wide, query, steps

_CFG = reports.Config(lags_ms=(900_000, 1_800_000), surrogates=200, fs=1.0, min_rate=1e-6, burst_events=5, burst_gap=1800.0, channel_burst_events=3, metrics=("degree", "clustering", "size", "density", "degree_mean", "strength_mean"))


@query("activity_report")
def activity_report(spark, d):
    return _rounded(reports.activity(views.spikes(spark, d), views.channels(spark, d), views.recordings(spark, d), _CFG)[0], 9)


@query("channel_report")
def channel_report(spark, d):
    return _rounded(reports.activity(views.spikes(spark, d), views.channels(spark, d), views.recordings(spark, d), _CFG)[1], 9)


def _network(spark, d):
    s, rec = views.spikes(spark, d), views.recordings(spark, d)
    return reports.network_metrics(reports.lag_edges(s, rec, _CFG), ev.firing_rates(s, views.channels(spark, d), rec), _CFG)


@query("network_report")
def network_report(spark, d):
    return _rounded(_network(spark, d)[0])


@query("node_report")
def node_report(spark, d):
    return _rounded(_network(spark, d)[1])


@query("metric_ranges")
def metric_ranges(spark, d):
    return _rounded(reports.metric_ranges(_network(spark, d)[0]))


@query("age_series", """SELECT c_mktsegment AS grp, n_regionkey AS div, 'balance' AS metric, count(*) AS n, round(avg(c_acctbal), 6) AS mean, round(stddev_samp(c_acctbal) / sqrt(count(*)), 6) AS sem
    FROM customer JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL""")
def age_series(spark, d):
    c = views.table(spark, d, "customer").join(views.table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    m = c.select(F.col("c_mktsegment").alias("grp"), F.col("n_regionkey").alias("div"), F.lit("balance").alias("metric"), F.col("c_acctbal").alias("value"))
    return _rounded(reports.age_series(m, ("grp", "div", "metric")))


@query("pattern_decoding")
def pattern_decoding(spark, d):
    stim = _stim(spark, d).withColumn("pattern", F.col("trial") % 3)
    r = stimulus.rate_tensor(views.spikes(spark, d), stim, 0.0, 7200.0, 600.0)
    x = learning.decoding_features(r, list(range(16)), (0, 12))
    return _rounded(learning.decode_patterns(x, [f"c{i}" for i in range(16)], sizes=(4,), repeats=1, folds=2), 4)


@query("permutation_importance")
def permutation_importance(spark, d):
    return _rounded(learning.permutation_importance(_wide(spark, d), "label", [f"x{i}" for i in range(64)]))


@query("regression_errors")
def regression_errors(spark, d):
    li = views.table(spark, d, "lineitem").select("l_extendedprice", "l_quantity", "l_discount", "l_tax")
    return _rounded(learning.regression_errors(li, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"]), 3)


@query("adaptive_response")
def adaptive_response(spark, d):
    return _rounded(rate_curves.adaptive_response(views.spikes(spark, d), _stim(spark, d), -7200.0, 7200.0, points=200), 9)


def _order_values(spark, d):
    """(metric, subject, grp, age, value): order totals of customers by year, market segment as group."""
    o, c = views.table(spark, d, "orders"), views.table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("grp"))
    return o.join(c, "o_custkey").select(F.col("o_orderstatus").alias("metric"), F.col("o_custkey").alias("subject"), "grp", F.year("o_orderdate").alias("age"), (F.col("o_totalprice") / 1e5).alias("value"))


@query("mixed_effects")
def mixed_effects(spark, d):
    return _rounded(mixed.mixed_effects(_order_values(spark, d), ["metric"], group="grp", interaction=True), 4)


@query("mixed_model_comparison")
def mixed_model_comparison(spark, d):
    v = _order_values(spark, d)
    return _rounded(mixed.compare_models(*(mixed.mixed_effects(v, ["metric"], group="grp", interaction=i, restricted=False) for i in (False, True)), ["metric"]), 4)


def _vectors(spark, d):
    return views.table(spark, d, "embeddings").select("vec_id", "label", *(F.col("embedding")[i].cast("double").alias(f"x{i}") for i in range(64)))


@query("nearest_neighbours", """WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS x FROM embeddings), p AS (SELECT a.vec_id, b.vec_id AS neighbour, list_distance(a.x, b.x) AS distance FROM v a JOIN v b ON a.vec_id <> b.vec_id)
    SELECT vec_id, rank::INT AS rank, neighbour, round(distance, 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY distance, neighbour) AS rank FROM p) WHERE rank <= 3""")
def nearest_neighbours(spark, d):
    return _rounded(neighbours.nearest_neighbours(_vectors(spark, d), [f"x{i}" for i in range(64)], 3, "vec_id"))


@query("knn_loss")
def knn_loss(spark, d):
    p = neighbours.knn_predictions(_vectors(spark, d), "label", [f"x{i}" for i in range(64)], 3, "vec_id")
    return _rounded(p.groupBy("label").agg(F.avg((F.col("label") != F.col("predicted")).cast("double")).alias("loss"), F.count(F.lit(1)).alias("n")))


@query("nmf_variance")
def nmf_variance(spark, d):
    return _rounded(kernels.nmf_variance(_hourly(spark, d), 720), 4)


@query("nmf_dimensions")
def nmf_dimensions(spark, d):
    return _rounded(kernels.nmf_dimensions(_hourly(spark, d), 720), 4)


def _hourly(spark, d):
    return views.spikes(spark, d).groupBy("rec", "ch", F.floor(F.col("t") / 3600).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


@query("structural_motifs")
def structural_motifs(spark, d):
    return _rounded(network.weighted_motifs3(steps(spark, d), KEY), 5)


@query("functional_motifs")
def functional_motifs(spark, d):
    return _rounded(network.weighted_motifs3(steps(spark, d), KEY, functional=True), 5)


@query("shuffled_labels")
def shuffled_labels(spark, d):
    return _rounded(learning.shuffled_label_test(learning.shuffled_label_losses(_vectors(spark, d), "label", [f"x{i}" for i in range(64)])))


@query("wide_null_participation")
def wide_null_participation(spark, d):
    """Participation against 100 null networks on recordings of 60 channels."""
    s = views.table(spark, d, "events").select(F.col("event_type").alias("rec"), (F.col("user_id") % 60).alias("ch"), ((F.unix_micros(F.col("ts").cast("timestamp")) - views.START_US) / 1e6).alias("t"))
    e = cut(connectivity.sttc(s.distinct(), views.recordings(spark, d), 1800.0))  # read four times below
    return _rounded(kernels.normalised_participation(e, _communities(e), KEY))
