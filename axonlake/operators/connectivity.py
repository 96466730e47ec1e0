"""Pairwise connectivity: spike-time tiling, surrogate significance, correlation, and edge clean-up.

Edges are rows (keys, src, dst, w) with src < dst and w > 0; keys are the recording and usually the lag.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.scalars import circular_shift, correlation, mixed


def tiled_fraction(spikes: DataFrame, recordings: DataFrame, dt: float, keys=("rec", "ch")) -> DataFrame:
    """(keys, n, ta): share of the recording within dt of an event. One event at either edge is cut there; more, at both."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("t")
    gap = F.col("t") - F.lag("t").over(w)
    s = spikes.withColumn("__over", F.when(gap < 2 * dt, 2 * dt - gap).otherwise(0.0))
    a = s.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.sum("__over").alias("over"), F.min("t").alias("first"), F.max("t").alias("last"))
    a = a.join(recordings.select("rec", "duration_s"), "rec")
    head = F.when(F.col("first") < dt, F.col("first") - dt).otherwise(0.0)
    tail = F.when(F.col("duration_s") - F.col("last") < dt, F.col("duration_s") - F.col("last") - dt).otherwise(0.0)
    edge = F.when((F.col("n") == 1) & (F.col("first") < dt), head).otherwise(head + tail)
    return a.select(*keys, "n", ((2 * F.col("n") * dt - F.col("over") + edge) / F.col("duration_s")).alias("ta"))


def coincidences(spikes: DataFrame, dt: float, keys=("rec",)) -> DataFrame:
    """(keys, a, b, hits): events of channel a with an event of channel b within dt.

    A channel is reduced to its first and last event of each time bucket of width dt. Of b's events the one nearest to an event of a is the
    last of the bucket before, the first of the bucket after, or either of the own bucket, whose events are all within dt; so an event meets
    at most one row of each channel, however many events lie near it. (keys, bucket) spreads a busy recording over its duration.
    """
    keys = list(keys)
    s = spikes.select(*keys, "ch", "t").distinct().withColumn("__k", F.floor(F.col("t") / dt))
    ends = s.groupBy(*keys, "ch", "__k").agg(F.min("t").alias("lo"), F.max("t").alias("hi"))
    beside = F.inline(F.array(*(F.struct((F.col("__k") - i).alias("__b"), *((F.col(c) if i == j else F.lit(None).cast("double")).alias(n) for j, c, n in ((-1, "hi", "before"), (0, "lo", "lo"), (0, "hi", "hi"), (1, "lo", "after")))) for i in (-1, 0, 1))))
    near = ends.select(*keys, F.col("ch").alias("b"), "__k", "lo", "hi").select(*keys, "b", beside)
    near = near.groupBy(*keys, F.col("__b").alias("__k"), "b").agg(*(F.max(c).alias(c) for c in ("before", "lo", "hi", "after")))
    hit = F.lit(False)
    for c in ("before", "lo", "hi", "after"):
        hit = hit | F.coalesce(F.abs(F.col("t") - F.col(c)) <= dt, F.lit(False))
    met = s.withColumnRenamed("ch", "a").join(near, [*keys, "__k"]).filter((F.col("a") != F.col("b")) & hit)
    return met.groupBy(*keys, "a", "b").agg(F.count(F.lit(1)).alias("hits"))


def sttc(spikes: DataFrame, recordings: DataFrame, dt: float, keys=("rec",), positive_only: bool = True) -> DataFrame:
    """Spike-time tiling coefficient of every pair of channels with events: keys, src, dst, w. Undefined counts as 0.

    spikes: distinct times per channel. positive_only: drop w <= 0, which pairs without coincidence always have.
    """
    keys = list(keys)
    t = tiled_fraction(spikes, recordings, dt, [*keys, "ch"])
    hits = coincidences(spikes, dt, keys)
    a = t.select(*keys, F.col("ch").alias("src"), F.col("n").alias("na"), F.col("ta"))
    b = t.select(*keys, F.col("ch").alias("dst"), F.col("n").alias("nb"), F.col("ta").alias("tb"))
    if positive_only:
        ab = hits.filter("a < b").select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"), F.col("hits").alias("hab"))
        pairs = ab.join(a, [*keys, "src"]).join(b, [*keys, "dst"])
    else:
        ab = hits.filter("a < b").select(*keys, F.col("a").alias("src"), F.col("b").alias("dst"), F.col("hits").alias("hab"))
        pairs = a.join(b, keys).filter("src < dst").join(ab, [*keys, "src", "dst"], "left")
    ba = hits.filter("a > b").select(*keys, F.col("b").alias("src"), F.col("a").alias("dst"), F.col("hits").alias("hba"))
    p = pairs.join(ba, [*keys, "src", "dst"], "left")
    pa, pb = F.coalesce("hab", F.lit(0)) / F.col("na"), F.coalesce("hba", F.lit(0)) / F.col("nb")
    w = 0.5 * (_term(pa, F.col("tb")) + _term(pb, F.col("ta")))
    out = p.select(*keys, "src", "dst", F.coalesce(w, F.lit(0.0)).alias("w"))
    return out.filter("w > 0") if positive_only else out


def _term(p: Column, t: Column) -> Column:
    return F.when(p * t != 1, (p - t) / (1 - p * t))


def surrogate_trains(spikes: DataFrame, recordings: DataFrame, reps: int, fs: float, seed: int = 1) -> DataFrame:
    """`reps` circularly shifted copies of every train: rec, ch, rep, t. The shift in samples comes from a hash of (seed, recording number, ch,
    rep), so it depends on neither partitioning nor order. recordings has rec, duration_s and rec_no (whole number)."""
    r = recordings.select("rec", "duration_s", "rec_no").withColumn("n", F.round(F.col("duration_s") * fs).cast("long"))
    s = spikes.join(r, "rec").withColumn("rep", F.explode(F.sequence(F.lit(1), F.lit(reps))))
    by = F.pmod(mixed(F.lit(seed), F.col("rec_no"), F.col("ch"), F.col("rep")), F.col("n")) + 1
    return s.select("rec", "ch", "rep", (circular_shift(F.round(F.col("t") * fs).cast("long"), by, F.col("n")) / fs).alias("t")).distinct()


def surrogate_weights(spikes: DataFrame, recordings: DataFrame, dt: float, reps: int, fs: float, seed: int = 1, block: int = 10) -> DataFrame:
    """(rec, src, dst, rep, w): positive tiling coefficients of `reps` surrogates, the shifts being those of surrogate_trains.

    Trains are collected per channel once; a group is one recording's channels and `block` replicates, so that events are sent once for each
    block and only coefficients come back. Inside a group coincidences are counted by sorted searches of the ends of the stretches that a
    train covers, of which a dense train has few, and a shifted train stays sorted but for one turn.
    """
    import math

    r = recordings.select("rec", "rec_no", "duration_s", F.round(F.col("duration_s") * fs).cast("long").alias("n"))
    trains = spikes.groupBy("rec", "ch").agg(F.array_sort(F.collect_list(F.round(F.col("t") * fs).cast("long"))).alias("at")).join(r, "rec")
    last = -(-reps // block) - 1
    dealt = trains.withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(last))))
    own = F.sequence(F.col("block") * block + 1, F.least((F.col("block") + 1) * block, F.lit(reps)))
    dealt = dealt.withColumn("by", F.transform(own, lambda rep: F.pmod(mixed(F.lit(seed), F.col("rec_no"), F.col("ch"), rep), F.col("n")) + 1))
    kinds = {c: spikes.schema[c].dataType.simpleString() for c in ("rec", "ch")}

    def run(pdf):
        import numpy as np
        import pandas as pd

        n, duration, near = int(pdf["n"].iloc[0]), float(pdf["duration_s"].iloc[0]), math.floor(dt * fs * (1 + 1e-12))
        names, out = pdf["ch"].to_numpy(), []
        order = np.argsort(names)
        trains = [np.unique(pdf["at"].iloc[i]) for i in order]
        for j in range(len(pdf["by"].iloc[0])):
            shifted = [_turned(x, int(pdf["by"].iloc[i][j]), n) for i, x in zip(order, trains)]
            covered = np.array([_tiled(x / fs, dt, duration) for x in shifted])
            size = np.array([len(x) for x in shifted])
            hits = np.zeros((len(order),) * 2)
            for b, x in enumerate(shifted):
                first, last = _spans(x, near)
                for a, y in enumerate(shifted):
                    if a != b:
                        hits[a, b] = (np.searchsorted(y, last, "right") - np.searchsorted(y, first, "left")).sum()
            share = hits / size[:, None]
            with np.errstate(divide="ignore", invalid="ignore"):
                term = (share - covered[None, :]) / (1 - share * covered[None, :])
            w = np.nan_to_num(0.5 * (term + term.T), nan=0.0, posinf=0.0, neginf=0.0)
            i, k = np.nonzero(np.triu(w > 0, 1))
            out.append(pd.DataFrame({"src": names[order][i], "dst": names[order][k], "rep": int(pdf["block"].iloc[0]) * block + j + 1, "w": w[i, k]}))
        got = pd.concat(out)
        got.insert(0, "rec", pdf["rec"].iloc[0])
        return got

    return dealt.groupBy("rec", "block").applyInPandas(run, f"rec {kinds['rec']}, src {kinds['ch']}, dst {kinds['ch']}, rep int, w double")


def _turned(at, by: int, n: int):
    """Ascending distinct samples moved by `by`, those past n put first."""
    import numpy as np

    k = int(np.searchsorted(at, n - by, "right"))
    moved = np.concatenate([at[k:] + (by - n), at[:k] + by])
    return moved if (np.diff(moved) > 0).all() else np.unique(moved)


def _spans(at, near: int):
    """(first, last) samples of the stretches within `near` samples of ascending ones; stretches do not meet."""
    import numpy as np

    new = np.flatnonzero(np.diff(at) > 2 * near + 1) + 1
    return at[np.concatenate([[0], new])] - near, at[np.concatenate([new, [len(at)]]) - 1] + near


def _tiled(t, dt: float, duration: float) -> float:
    """Share of the recording within dt of the times t, as tiled_fraction has it."""
    import numpy as np

    gap = np.diff(t)
    over = float((2 * dt - gap[gap < 2 * dt]).sum())
    head = t[0] - dt if t[0] < dt else 0.0
    tail = duration - t[-1] - dt if duration - t[-1] < dt else 0.0
    edge = head if len(t) == 1 and t[0] < dt else head + tail
    return (2 * len(t) * dt - over + edge) / duration


def kth_smallest(rows: DataFrame, keys: list[str], value: str, reps: int, tail: float) -> DataFrame:
    """(keys, cut): k-th smallest of `reps` values, k = ceil((1 - tail) reps) kept within 1..reps. Missing rows count as value 0."""
    import math

    k = min(max(math.ceil((1 - tail) * reps), 1), reps)
    g = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(value)).alias("__a"))  # at most reps values
    at = k - (reps - F.size("__a"))
    return g.select(*keys, F.when(at >= 1, F.element_at("__a", F.greatest(at, F.lit(1)))).otherwise(0.0).alias("cut"))


def significant_edges(spikes: DataFrame, recordings: DataFrame, dt: float, reps: int = 200, tail: float = 0.05, fs: float = 12500.0, seed: int = 1) -> DataFrame:
    """STTC edges whose weight is at least the surrogate cut-off."""
    real = sttc(spikes, recordings, dt)
    null = surrogate_weights(spikes, recordings, dt, reps, fs, seed)
    cut = kth_smallest(null, ["rec", "src", "dst"], "w", reps, tail)
    return real.join(cut, ["rec", "src", "dst"], "left").filter(F.col("w") >= F.coalesce("cut", F.lit(0.0))).select("rec", "src", "dst", "w")


def threshold_checkpoints(null: DataFrame, reps: int, tail: float, step: int = 10) -> DataFrame:
    """Cut-offs from the first 1, 10, 20, ... surrogates: rec, src, dst, checkpoint, cut, and the running mean and variance of cuts."""
    import math

    points = [1, *range(step, reps + 1, step)]
    ks = F.create_map(*(F.lit(x) for p in points for x in (p, min(max(math.ceil((1 - tail) * p), 1), p))))
    at = null.withColumn("checkpoint", F.explode(F.array(*map(F.lit, points)))).filter("rep <= checkpoint")
    g = at.groupBy("rec", "src", "dst", "checkpoint").agg(F.sort_array(F.collect_list("w")).alias("__a"))
    i = ks[F.col("checkpoint")] - (F.col("checkpoint") - F.size("__a"))
    g = g.select("rec", "src", "dst", "checkpoint", F.when(i >= 1, F.element_at("__a", F.greatest(i, F.lit(1)))).otherwise(0.0).alias("cut"))
    w = Window.partitionBy("rec", "src", "dst").orderBy("checkpoint").rowsBetween(Window.unboundedPreceding, 0)
    return g.withColumns({"mean_cut": F.avg("cut").over(w), "var_cut": F.var_pop("cut").over(w)})


def correlations(frames: DataFrame, keys=("rec",), unit: str = "roi", time: str = "frame", value: str = "f") -> DataFrame:
    """Pearson correlation of every pair of units over common frames: keys, src, dst, w (null where a unit is constant)."""
    keys = list(keys)
    a = frames.select(*keys, F.col(time).alias("__t"), F.col(unit).alias("src"), F.col(value).alias("x"))
    b = frames.select(*keys, F.col(time).alias("__t"), F.col(unit).alias("dst"), F.col(value).alias("y"))
    p = a.join(b, [*keys, "__t"]).filter("src < dst")
    return p.groupBy(*keys, "src", "dst").agg(correlation("x", "y").alias("w"))


def clean(edges: DataFrame) -> DataFrame:
    """Null, NaN and negative weights are no edge."""
    return edges.withColumn("w", F.nanvl("w", F.lit(0.0))).filter("w > 0")


def binarise(edges: DataFrame) -> DataFrame:
    return edges.withColumn("w", F.lit(1.0))


def normalise(edges: DataFrame, keys: list[str]) -> DataFrame:
    return edges.withColumn("w", F.col("w") / F.max(F.abs("w")).over(Window.partitionBy(*keys)))


def lengths(edges: DataFrame) -> DataFrame:
    return edges.withColumn("length", 1 / F.col("w"))


def above(edges: DataFrame, cut: float) -> DataFrame:
    return edges.filter(F.col("w") >= cut)


def proportional(edges: DataFrame, nodes: DataFrame, keys: list[str], share: float) -> DataFrame:
    """The strongest share of all possible pairs, half up; ties by src, dst."""
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("__n"))
    w = Window.partitionBy(*keys).orderBy(F.desc("w"), "src", "dst")
    e = edges.withColumn("__rn", F.row_number().over(w)).join(n, keys)
    return e.filter(F.col("__rn") <= F.round(share * F.col("__n") * (F.col("__n") - 1) / 2)).drop("__rn", "__n")


def strongest(edges: DataFrame, keys: list[str], k: int) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy(F.desc(F.abs("w")), "src", "dst")
    return edges.withColumn("__rn", F.row_number().over(w)).filter(F.col("__rn") <= k).drop("__rn")


def percentile_cut(edges: DataFrame, nodes: DataFrame, keys: list[str], q: float, of_all_entries: bool = True) -> DataFrame:
    """(keys, cut): linear percentile of the weights, either of all n*n matrix entries (zeros and diagonal included) or of edges only."""
    if not of_all_entries:
        return edges.groupBy(*keys).agg(F.percentile("w", F.lit(q)).alias("cut"))
    n = nodes.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*keys).orderBy("w")
    ranked = edges.withColumns({"rn": F.row_number().over(w), "m": F.count(F.lit(1)).over(Window.partitionBy(*keys))}).join(n, keys)
    # an edge stands twice in the matrix; zeros fill ranks 1 .. n*n - 2m
    last = F.col("n") * F.col("n") - 2 * F.col("m") + 2 * F.col("rn")
    pos = q * (F.col("n") * F.col("n") - 1) + 1
    lo, hi = F.floor(pos), F.ceil(pos)
    r = ranked.withColumns({"last": last, "lo": lo, "hi": hi, "frac": pos - lo})
    g = r.groupBy(*keys).agg(
        F.max("frac").alias("frac"), F.max(F.when((F.col("last") - 1 <= F.col("lo")) & (F.col("lo") <= F.col("last")), F.col("w"))).alias("a"),
        F.max(F.when((F.col("last") - 1 <= F.col("hi")) & (F.col("hi") <= F.col("last")), F.col("w"))).alias("b"),
    )
    a, b = F.coalesce("a", F.lit(0.0)), F.coalesce("b", F.lit(0.0))
    return g.select(*keys, (a + (b - a) * F.col("frac")).alias("cut"))


def active_nodes(edges: DataFrame, rates: DataFrame, keys: list[str], min_rate: float, min_nodes: int = 3) -> DataFrame:
    """Nodes with an edge and a rate of at least min_rate, of networks with at least min_nodes of them: keys, ch."""
    s = both_ways(edges, keys).select(*keys, F.col("src").alias("ch")).distinct()
    a = s.join(rates.filter(F.col("rate") >= min_rate).select("rec", "ch"), ["rec", "ch"], "left_semi")
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    return a.withColumn("__n", n).filter(F.col("__n") >= min_nodes).drop("__n")


def both_ways(edges: DataFrame, keys: list[str]) -> DataFrame:
    """Every edge in both directions."""
    return edges.select(*keys, "src", "dst", "w").unionByName(edges.select(*keys, F.col("dst").alias("src"), F.col("src").alias("dst"), "w"))
