"""Whole analyses as one lazy plan: activity and network reports at recording and node level, from a registry of metrics by name."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import connectivity as conn
from ..operators import events as ev
from ..operators import kernels, network

KEYS = ["rec", "lag"]


@dataclass(frozen=True)
class Config:
    """Parameters of a run; times in seconds, lags in milliseconds."""

    method: str | None = None
    lags_ms: tuple[int, ...] = (10, 15, 25)
    surrogates: int = 200
    tail: float = 0.05
    fs: float = 12500.0
    min_rate: float = 0.01
    min_nodes: int = 3
    burst_events: int = 10
    burst_gap: float = 0.1
    burst_channels: int = 3
    channel_burst_events: int = 5
    seed: int = 1
    metrics: tuple[str, ...] = field(default=())


@dataclass(frozen=True)
class Metric:
    level: str  # rec or node
    make: Callable[[DataFrame, DataFrame], DataFrame]  # (edges, nodes) -> keys[, node], metric columns


def _mean_of_nodes(f, column: str, name: str):
    return lambda e, n: f(e, n).groupBy(*KEYS).agg(F.avg(column).alias(name))


_degrees = lambda e, n: network.degrees(e, KEYS).select(*KEYS, "node", F.col("degree").alias("ND"), F.col("mean_weight").alias("MEW"), F.col("strength").alias("NS"))
_communities = lambda e: kernels.consensus_communities(e, KEYS)

REGISTRY: dict[str, Metric] = {
    "degree": Metric("node", _degrees),
    "clustering": Metric("node", lambda e, n: network.clustering(e, KEYS).withColumnRenamed("cc", "CC")),
    "betweenness": Metric("node", lambda e, n: kernels.betweenness(e, KEYS).withColumnRenamed("bc", "BC")),
    "participation": Metric("node", lambda e, n: network.participation(e, _communities(e), KEYS).withColumnRenamed("pc", "PC")),
    "module_z": Metric("node", lambda e, n: network.module_zscore(e, _communities(e), KEYS).withColumnRenamed("z", "Z")),
    "local_efficiency": Metric("node", lambda e, n: network.local_efficiency(e, KEYS).withColumnRenamed("eloc", "Eloc")),
    "nodal_efficiency": Metric("node", lambda e, n: network.nodal_efficiency(network.shortest_paths(e, KEYS), n, KEYS).withColumnRenamed("ne", "NE")),
    "controllability": Metric("node", lambda e, n: kernels.controllability(e, KEYS).select(*KEYS, "node", F.col("average").alias("aveControl"), F.col("modal").alias("modalControl"))),
    "size": Metric("rec", lambda e, n: n.groupBy(*KEYS).agg(F.count(F.lit(1)).cast("double").alias("aN"))),
    "density": Metric("rec", lambda e, n: network.density(e, n, KEYS).select(*KEYS, F.col("density").alias("Dens"))),
    "paths": Metric("rec", lambda e, n: network.path_metrics(network.shortest_paths(e, KEYS), n, KEYS).select(*KEYS, F.col("path_length").alias("PL"), F.col("global_efficiency").alias("Eglob"))),
    "modularity": Metric("rec", lambda e, n: network.modularity(e, _communities(e), KEYS).withColumnRenamed("q", "Q")),
    "degree_mean": Metric("rec", _mean_of_nodes(_degrees, "ND", "NDmean")),
    "strength_mean": Metric("rec", _mean_of_nodes(_degrees, "NS", "NSmean")),
    "small_world": Metric("rec", lambda e, n: kernels.small_worldness(e, KEYS).select(*KEYS, F.col("sigma").alias("SW"), F.col("omega").alias("SWw"))),
}


def lag_edges(spikes: DataFrame, recordings: DataFrame, cfg: Config) -> DataFrame:
    """Significant tiling edges of every lag: rec, lag, src, dst, w."""
    trains, out = spikes.select("rec", "ch", "t").distinct(), None
    for ms in cfg.lags_ms:
        if cfg.surrogates:
            e = conn.significant_edges(trains, recordings, ms / 1000, cfg.surrogates, cfg.tail, cfg.fs, cfg.seed)
        else:
            e = conn.sttc(trains, recordings, ms / 1000)
        e = e.withColumn("lag", F.lit(ms))
        out = e if out is None else out.unionByName(e)
    return out.select(*KEYS, "src", "dst", "w")


def activity(spikes: DataFrame, channels: DataFrame, recordings: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(recording level, node level) tables of rates and bursts."""
    rates = ev.firing_rates(spikes, channels, recordings)
    nets = ev.network_bursts(spikes, cfg.burst_events, cfg.burst_gap, cfg.burst_channels)
    rec = recordings.select("rec").join(ev.rate_summary(rates, cfg.min_rate), "rec", "left").join(ev.burst_summary(spikes, nets, recordings), "rec", "left")
    node = rates.join(ev.channel_burst_summary(spikes, ev.bursts(spikes, cfg.channel_burst_events, cfg.burst_gap), recordings), ["rec", "ch"], "left")
    return rec, node


def network_metrics(edges: DataFrame, rates: DataFrame, cfg: Config) -> tuple[DataFrame, DataFrame]:
    """(recording level, node level) long tables (keys[, node], metric, value) of the metrics named in cfg, all of the registry if none is."""
    active = conn.active_nodes(edges, rates, KEYS, cfg.min_rate, cfg.min_nodes)
    nodes = active.select(*KEYS, F.col("ch").alias("node"))
    e = edges.join(nodes.withColumnRenamed("node", "src"), [*KEYS, "src"], "left_semi").join(nodes.withColumnRenamed("node", "dst"), [*KEYS, "dst"], "left_semi").select(*KEYS, "src", "dst", "w")
    from ..functions.iterate import cut

    e, nodes, out = cut(e), cut(nodes), {"rec": None, "node": None}
    for name in cfg.metrics or tuple(REGISTRY):
        m = REGISTRY[name]
        ids = KEYS if m.level == "rec" else [*KEYS, "node"]
        wide = m.make(e, nodes)
        values = [c for c in wide.columns if c not in ids]
        long = wide.select(*ids, *(F.col(c).cast("double").alias(c) for c in values)).unpivot(ids, values, "metric", "value")
        out[m.level] = long if out[m.level] is None else out[m.level].unionByName(long)
    return out["rec"], out["node"]


def with_roster(metrics: DataFrame, roster: DataFrame) -> DataFrame:
    """Metric rows with the recording's group and age."""
    return metrics.join(roster.select("rec", "grp", "div"), "rec", "left")


def age_series(metrics: DataFrame, ids=("grp", "div", "lag", "metric")) -> DataFrame:
    """Mean and standard error per group, age, lag and metric."""
    return metrics.groupBy(*ids).agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.try_divide(F.stddev_samp("value"), F.sqrt(F.count("value"))).alias("sem"))


def metric_ranges(metrics: DataFrame) -> DataFrame:
    """Least and largest finite value of each metric over the batch."""
    v = F.when(F.abs("value") < float("inf"), F.col("value"))
    return metrics.groupBy("metric").agg(F.min(v).alias("lo"), F.max(v).alias("hi"))
