"""Operators on event tables (rec, ch, t): selection, rates, gaps, bursts, runs, histograms and set operations.

Everything is keyed by recording (and channel), so a batch of recordings is one job. A channel without events stays a row: summaries
start from the channel dimension.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

TRAIN = ("rec", "ch")


def of_method(spikes: DataFrame, channels: DataFrame, method: str) -> DataFrame:
    """Events of one detection method; channels without any have one row with a null t."""
    return channels.join(spikes.filter(F.col("method") == method).select(*TRAIN, "t"), list(TRAIN), "left")


def has_events(spikes: DataFrame, recordings: DataFrame) -> DataFrame:
    return recordings.join(spikes.groupBy("rec").agg(F.count(F.lit(1)).alias("n")), "rec", "left").select("rec", (F.coalesce("n", F.lit(0)) > 0).alias("any_events"))


def drop_grounded(spikes: DataFrame, recordings: DataFrame) -> DataFrame:
    """Without events on channels that the recording's `ground` array lists."""
    return spikes.join(recordings.select("rec", F.explode("ground").alias("ch")), list(TRAIN), "left_anti")


def truncate(spikes: DataFrame, recordings: DataFrame, seconds: float) -> tuple[DataFrame, DataFrame]:
    return spikes.filter(F.col("t") <= seconds), recordings.withColumn("duration_s", F.least("duration_s", F.lit(seconds)))


def firing_rates(spikes: DataFrame, channels: DataFrame, recordings: DataFrame) -> DataFrame:
    """(rec, ch, n, rate) for every channel; silent channels have rate 0."""
    n = spikes.groupBy(*TRAIN).agg(F.count(F.lit(1)).alias("n"))
    out = channels.join(n, list(TRAIN), "left").join(recordings.select("rec", "duration_s"), "rec")
    return out.select(*TRAIN, F.coalesce("n", F.lit(0)).alias("n"), (F.coalesce("n", F.lit(0)) / F.col("duration_s")).alias("rate"))


def rate_summary(rates: DataFrame, min_rate: float, digits: int = 3) -> DataFrame:
    """Per recording over active channels: mean, std, sem (from the rounded std), median, iqr, n; rounded half to even."""
    a = rates.filter(F.col("rate") >= min_rate).groupBy("rec").agg(
        F.bround(F.avg("rate"), digits).alias("fr_mean"), F.bround(F.stddev_samp("rate"), digits).alias("fr_std"),
        F.bround(F.percentile("rate", F.lit(0.5)), digits).alias("fr_median"),
        F.bround(F.percentile("rate", F.lit(0.75)) - F.percentile("rate", F.lit(0.25)), digits).alias("fr_iqr"), F.count(F.lit(1)).alias("n_active"),
    )
    return a.withColumn("fr_sem", F.bround(F.col("fr_std") / F.sqrt("n_active"), digits))


def gaps(spikes: DataFrame, keys=TRAIN) -> DataFrame:
    w = Window.partitionBy(*keys).orderBy("t")
    return spikes.withColumn("isi", F.col("t") - F.lag("t").over(w))


def burst_criteria(spikes: DataFrame, n: int, threshold, keys=TRAIN) -> DataFrame:
    """span: time over the n events that end here; crit: some run of n events that holds this one spans at most threshold; i: index."""
    w = Window.partitionBy(*keys).orderBy("t")
    s = spikes.withColumns({"i": F.row_number().over(w) - 1, "span": F.col("t") - F.lag("t", n - 1).over(w)})
    ok = F.coalesce((F.col("span") <= threshold).cast("int"), F.lit(0))
    return s.withColumn("__ok", ok).withColumn("crit", F.max("__ok").over(w.rowsBetween(0, n - 1)) == 1).drop("__ok")


def bursts(spikes: DataFrame, n: int, threshold: float, keys=TRAIN) -> DataFrame:
    """(keys, t0, t1, n): bursts of at least n events. The scan starts at the n-th event; inside a run of events that meet the criterion a
    burst of n or more is closed where the span exceeds the threshold; shorter ones are dropped. Each run is one small group."""
    keys = list(keys)
    s = burst_criteria(spikes, n, threshold, keys)
    w = Window.partitionBy(*keys).orderBy("t")
    s = s.withColumn("run", F.sum((~F.col("crit")).cast("int")).over(w)).filter(F.col("crit") & (F.col("i") >= n - 1))
    kinds = ", ".join(f"{k} {spikes.schema[k].dataType.simpleString()}" for k in keys)

    def scan(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("t")
        parts, now = [], []
        for t, span in zip(pdf["t"], pdf["span"]):
            if len(now) >= n and span > threshold:
                parts.append(now)
                now = []
            now.append(t)
        parts.append(now)
        kept = [(p[0], p[-1], len(p)) for p in parts if len(p) >= n]
        out = pd.DataFrame(kept, columns=["t0", "t1", "n"])
        for k in keys:
            out[k] = pdf[k].iloc[0]
        return out[[*keys, "t0", "t1", "n"]]

    return s.select(*keys, "run", "t", "span").groupBy(*keys, "run").applyInPandas(scan, f"{kinds}, t0 double, t1 double, n long")


def network_bursts(spikes: DataFrame, n: int, threshold: float, min_channels: int) -> DataFrame:
    """Bursts of the pooled distinct times of a recording that at least min_channels channels take part in: rec, t0, t1, n, channels."""
    found = bursts(spikes.select("rec", "t").distinct(), n, threshold, ["rec"])
    inside = events_in(spikes, found)
    seen = inside.groupBy("rec", "t0").agg(F.count_distinct("ch").alias("channels"))
    return found.join(seen, ["rec", "t0"]).filter(F.col("channels") >= min_channels)


def events_in(spikes: DataFrame, intervals: DataFrame) -> DataFrame:
    """Events with the interval (t0, t1) of their recording that holds them; intervals of a recording do not overlap."""
    from .joins import as_of

    starts = intervals.select("rec", F.col("t0").alias("t"), F.struct("t0", "t1").alias("iv"))
    return as_of(spikes, starts, ["rec"], "iv", strict=False).filter("t <= iv.t1").select(*spikes.columns, "iv.t0", "iv.t1")


def burst_summary(spikes: DataFrame, found: DataFrame, recordings: DataFrame) -> DataFrame:
    """Network-burst summary per recording: rate per minute, mean length, mean channels, CV of the gap between bursts, fraction of events inside."""
    w = Window.partitionBy("rec").orderBy("t0")
    g = found.withColumn("ibi", F.col("t0") - F.lag("t1").over(w))
    a = g.groupBy("rec").agg(F.count(F.lit(1)).alias("n_bursts"), F.avg(F.col("t1") - F.col("t0")).alias("mean_length"), F.avg("channels").alias("mean_channels"), F.try_divide(F.stddev_samp("ibi"), F.avg("ibi")).alias("cv_ibi"))
    inside = events_in(spikes, found).groupBy("rec").agg(F.count(F.lit(1)).alias("n_in"))
    total = spikes.groupBy("rec").agg(F.count(F.lit(1)).alias("n_all"))
    out = recordings.join(total, "rec", "left").join(a, "rec", "left").join(inside, "rec", "left")
    return out.select("rec", F.coalesce("n_bursts", F.lit(0)).alias("n_bursts"), (F.coalesce("n_bursts", F.lit(0)) / (F.col("duration_s") / 60)).alias("burst_rate"), "mean_length", "mean_channels", "cv_ibi", (F.coalesce("n_in", F.lit(0)) / F.col("n_all")).alias("fraction_in_bursts"))


def channel_burst_summary(spikes: DataFrame, found: DataFrame, recordings: DataFrame) -> DataFrame:
    """Per channel: burst rate per minute, mean duration, events per second inside, fraction of events inside; channels without bursts have rate 0."""
    all_ = spikes.groupBy(*TRAIN).agg(F.count(F.lit(1)).alias("n_all"))
    b = found.groupBy(*TRAIN).agg(F.count(F.lit(1)).alias("n_bursts"), F.avg(F.col("t1") - F.col("t0")).alias("mean_duration"), F.sum("n").alias("n_in"), F.avg(F.try_divide(F.col("n"), F.col("t1") - F.col("t0"))).alias("rate_in"))
    out = all_.join(b, list(TRAIN), "left").join(recordings.select("rec", "duration_s"), "rec")
    zero = F.lit(0)
    return out.select(*TRAIN, (F.coalesce("n_bursts", zero) / (F.col("duration_s") / 60)).alias("burst_rate"), "mean_duration", "rate_in", (F.coalesce("n_in", zero) / F.col("n_all")).alias("fraction_in_bursts"))


def array_bursts(spikes: DataFrame, found: DataFrame, recordings: DataFrame) -> DataFrame:
    """(rec, bursting, burst_rate, in_burst_rate, duration_ms, isi_in_ms, isi_out_ms, fraction): medians over the channels with bursts of bursts per
    minute, mean events per second inside, mean duration, mean over bursts of the mean gap inside, and mean gap between the events outside;
    `bursting` lists these channels, `fraction` is events in bursts over all events. Recordings without bursts have an empty list, null medians and
    fraction 0 (null without events). Gaps of a run add up to its span, so spans and counts suffice."""
    span = F.col("t1") - F.col("t0")
    inside = found.groupBy(*TRAIN).agg(F.count(F.lit(1)).alias("bursts"), F.avg(F.try_divide(F.col("n"), span)).alias("in_burst_rate"), F.avg(span * 1000).alias("duration_ms"), F.avg(F.try_divide(span * 1000, F.col("n") - 1)).alias("isi_in_ms"), F.sum("n").alias("n"))
    left = outside_bursts(spikes, found, list(TRAIN)).groupBy(*TRAIN).agg(F.try_divide((F.max("t") - F.min("t")) * 1000, F.count(F.lit(1)) - 1).alias("isi_out_ms"))
    c = inside.join(left, list(TRAIN), "left").join(recordings.select("rec", "duration_s"), "rec")
    c = c.withColumn("burst_rate", F.try_divide(F.col("bursts") * 60, F.col("duration_s")))
    names = ("burst_rate", "in_burst_rate", "duration_ms", "isi_in_ms", "isi_out_ms")
    m = c.groupBy("rec").agg(F.sort_array(F.collect_list("ch")).alias("bursting"), *(F.percentile(v, F.lit(0.5)).alias(v) for v in names), F.sum("n").alias("n"))
    total = spikes.groupBy("rec").agg(F.count(F.lit(1)).alias("all"))
    none = F.array().cast(f"array<{spikes.schema['ch'].dataType.simpleString()}>")
    out = recordings.select("rec").join(m, "rec", "left").join(total, "rec", "left")
    return out.select("rec", F.coalesce("bursting", none).alias("bursting"), *names, (F.coalesce("n", F.lit(0)) / F.col("all")).alias("fraction"))


def automatic_gap_threshold(spikes: DataFrame, n: int = 10, cap: float = 0.1, keys=TRAIN) -> DataFrame:
    """(keys, threshold): the valley between the first two peaks of the smoothed log-histogram of spans of n events.

    Bins are 10**(-5..1.5, step 0.05) milliseconds, smoothed by a moving line fit over nine bins; one peak gives 0 where the longest gap is
    under the cap and the cap otherwise; trains with ten distinct gaps or fewer use the cap. The histogram is native; the peak search sees one
    small histogram per train.
    """
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("t")
    s = spikes.withColumns({"span": F.col("t") - F.lag("t", n - 1).over(w), "gap": F.col("t") - F.lag("t").over(w)}).filter("span is not null")
    s = s.withColumn("bin", F.floor((F.log10(F.col("span") * 1000) + 5) / 0.05).cast("int"))
    hist = s.filter("span > 0 and bin between 0 and 129").groupBy(*keys, "bin").agg(F.count(F.lit(1)).alias("n"))
    facts = s.groupBy(*keys).agg(F.max("gap").alias("longest"), F.count_distinct("gap").alias("distinct_gaps"))
    joined = facts.join(hist, keys, "left")
    kinds = ", ".join(f"{k} {spikes.schema[k].dataType.simpleString()}" for k in keys)

    def valley(pdf: pd.DataFrame) -> pd.DataFrame:
        h = np.zeros(130)
        ok = pdf["bin"].notna()
        h[pdf["bin"][ok].astype(int)] = pdf["n"][ok]
        smooth = np.convolve(h, np.ones(9), "same") / 9  # a line's value amid its nine bins is their mean, exact for counts: no peaks by rounding
        for ends, lo in ((range(4), 0), (range(126, 130), 121)):
            line = np.polyfit(np.arange(9), h[lo : lo + 9], 1)
            smooth[ends.start : ends.stop] = [round(float(np.polyval(line, i - lo)), 9) for i in ends]
        peaks = [i for i in range(1, 129) if smooth[i] > smooth[i - 1] and smooth[i] >= smooth[i + 1] and smooth[i] > 0]
        peaks = [p for j, p in enumerate(peaks) if j == 0 or p - peaks[j - 1] >= 2]
        if pdf["distinct_gaps"].iloc[0] <= 10:
            th = cap
        elif len(peaks) >= 2:
            low = peaks[0] + int(np.argmin(smooth[peaks[0] : peaks[1] + 1]))
            th = min(cap, 10 ** (low * 0.05 - 5) / 1000)
        else:
            th = 0.0 if pdf["longest"].iloc[0] < cap else cap
        return pd.DataFrame({**{k: [pdf[k].iloc[0]] for k in keys}, "threshold": [th]})

    return joined.groupBy(*keys).applyInPandas(valley, f"{kinds}, threshold double")


def zscore_bursts(spikes: DataFrame, channels: DataFrame, recordings: DataFrame, bin_s: float = 1.0, peak: float = 1.5) -> DataFrame:
    """Network bursts by activity: per channel z-score of binned counts, mean over channels, local peaks of at least `peak`: rec, bin, z."""
    n = spikes.groupBy(*TRAIN, F.floor(F.col("t") / bin_s).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    bins = recordings.select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.ceil(F.col("duration_s") / bin_s) - 1)).alias("bin"), F.ceil(F.col("duration_s") / bin_s).alias("k"))
    m = n.join(recordings.select("rec", F.ceil(F.col("duration_s") / bin_s).alias("k")), "rec").groupBy("rec", "ch", "k").agg(F.sum("n").alias("s"), F.sum(F.col("n") * F.col("n")).alias("q"))
    m = m.withColumns({"mu": F.col("s") / F.col("k"), "sd": F.sqrt((F.col("q") - F.col("s") * F.col("s") / F.col("k")) / (F.col("k") - 1))}).filter("sd > 0")
    per = channels.groupBy("rec").agg(F.count(F.lit(1)).alias("m"))
    base = m.groupBy("rec").agg(F.sum(-F.col("mu") / F.col("sd")).alias("rest"))  # z summed over channels without events in the bin
    add = n.join(m, list(TRAIN)).groupBy("rec", "bin").agg(F.sum(F.col("n") / F.col("sd")).alias("add"))
    z = bins.select("rec", "bin").join(base, "rec").join(per, "rec").join(add, ["rec", "bin"], "left").withColumn("z", (F.col("rest") + F.coalesce("add", F.lit(0.0))) / F.col("m"))
    w = Window.partitionBy("rec").orderBy("bin")
    z = z.withColumns({"p": F.lag("z").over(w), "f": F.lead("z").over(w)})
    return z.filter((F.col("z") >= peak) & (F.coalesce("p", F.lit(float("-inf"))) < F.col("z")) & (F.coalesce("f", F.lit(float("-inf"))) <= F.col("z"))).select("rec", "bin", "z")


def runs(rows: DataFrame, keys: list[str], order: list[str], value: str) -> DataFrame:
    """Run-length encoding of constant-value runs: keys, value, start (from 0), length."""
    w = Window.partitionBy(*keys).orderBy(*order)
    r = rows.withColumns({"i": F.row_number().over(w) - 1, "__new": (~F.col(value).eqNullSafe(F.lag(value).over(w)) | F.lag(F.lit(1)).over(w).isNull()).cast("int")})
    r = r.withColumn("__run", F.sum("__new").over(w))
    return r.groupBy(*keys, "__run", value).agg(F.min("i").alias("start"), F.count(F.lit(1)).alias("length")).drop("__run")


def zscore(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Population z-score of value within keys; null where the deviation is 0."""
    w = Window.partitionBy(*keys)
    sd = F.stddev_pop(value).over(w)
    return rows.withColumn("z", F.when(sd > 0, (F.col(value) - F.avg(value).over(w)) / sd))


def binned(spikes: DataFrame, width: float, keys=TRAIN) -> DataFrame:
    return spikes.groupBy(*keys, F.floor(F.col("t") / width).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def histogram(rows: DataFrame, keys: list[str], value: str, lo: float, hi: float, bins: int) -> DataFrame:
    """Counts in equal bins of [lo, hi]; the last edge is inclusive; empty bins are rows too."""
    width = (hi - lo) / bins
    b = F.least(F.floor((F.col(value) - lo) / width), F.lit(bins - 1))
    n = rows.filter(F.col(value).between(lo, hi)).groupBy(*keys, b.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    grid = rows.select(*keys).distinct().withColumn("bin", F.explode(F.sequence(F.lit(0), F.lit(bins - 1))))
    return grid.join(n, [*keys, "bin"], "left").withColumn("n", F.coalesce("n", F.lit(0)))


def frame_bins(frames: DataFrame, bin_ms: float, fs: float, value: str = "f", keys=("rec", "roi")) -> DataFrame:
    """Mean over blocks of max(1, floor(bin_ms fs / 1000 + 1/2)) frames; an incomplete last block is dropped."""
    import math

    k = max(1, math.floor(bin_ms * fs / 1000 + 0.5))
    out = frames.groupBy(*keys, F.floor(F.col("frame") / k).alias("bin")).agg(F.avg(value).alias(value), F.count(F.lit(1)).alias("__n"))
    return out.filter(F.col("__n") == k).drop("__n")


def top_share_by_value(rows: DataFrame, keys: list[str], value: str, share: float = 0.1) -> DataFrame:
    """Rows at or above the value of rank round-half-up(n * share): ties included."""
    w = Window.partitionBy(*keys).orderBy(F.desc(value))
    n = F.count(F.lit(1)).over(Window.partitionBy(*keys))
    r = rows.withColumns({"__rn": F.row_number().over(w), "__k": F.floor(n * share + 0.5)})
    cut = F.max(F.when(F.col("__rn") == F.col("__k"), F.col(value))).over(Window.partitionBy(*keys))
    return r.withColumn("__cut", cut).filter(F.col(value) >= F.col("__cut")).drop("__rn", "__k", "__cut")


def refractory(crossings: DataFrame, frames: int, keys=TRAIN) -> DataFrame:
    """Greedy refractory rule: keep a crossing, skip all up to `frames` after the kept one. Runs of crossings closer than that are
    independent, so each is folded on its own as a sorted array."""
    keys = list(keys)
    w = Window.partitionBy(*keys).orderBy("frame")
    far = F.coalesce((F.col("frame") - F.lag("frame").over(w) > frames).cast("int"), F.lit(1))
    r = crossings.withColumn("__far", far).withColumn("__run", F.sum("__far").over(w))
    folded = r.groupBy(*keys, "__run").agg(F.sort_array(F.collect_list("frame")).alias("a"))
    kept = F.aggregate("a", F.array().cast("array<bigint>"), lambda acc, x: F.when((F.size(acc) == 0) | (x > F.element_at(acc, -1) + frames), F.concat(acc, F.array(x.cast("bigint")))).otherwise(acc))
    return folded.select(*keys, F.explode(kept).alias("frame"))


def merged_methods(spikes: DataFrame, methods: list[str] | None = None) -> DataFrame:
    """Distinct times over all (or the given) methods."""
    return (spikes if methods is None else spikes.filter(F.col("method").isin(methods))).select(*TRAIN, "t").distinct()


def method_overlap(spikes: DataFrame) -> DataFrame:
    """Per method the times that only it found, and per recording those that two or more share (method 'shared')."""
    by = spikes.groupBy(*TRAIN, "t").agg(F.count_distinct("method").alias("k"), F.min("method").alias("m"))
    return by.groupBy("rec", F.when(F.col("k") > 1, F.lit("shared")).otherwise(F.col("m")).alias("method")).agg(F.count(F.lit(1)).alias("n"))


def outside_bursts(spikes: DataFrame, found: DataFrame, keys=("rec",)) -> DataFrame:
    from .joins import outside_intervals

    return outside_intervals(spikes, found.select(*keys, "t0", "t1"), list(keys))


def in_every_age(rows: DataFrame, subject: str, age: str) -> DataFrame:
    """Subjects present at every age of the table."""
    total = rows.agg(F.count_distinct(age).alias("__k"))
    return rows.groupBy(subject).agg(F.count_distinct(age).alias("__n")).join(F.broadcast(total)).filter("__n = __k").select(subject)  # one row


def mode(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Most frequent value, the smallest on ties."""
    return rows.groupBy(*keys).agg(F.mode(value, True).alias(value))


def zscore_burst_counts(spikes: DataFrame, channels: DataFrame, recordings: DataFrame, bin_s: float = 1.0, thresholds: int = 50, top: float = 5.0) -> DataFrame:
    """(rec, threshold, n): number of activity peaks at each of `thresholds` levels up to `top`."""
    z = zscore_bursts(spikes, channels, recordings, bin_s, 0.0)
    levels = F.explode(F.array(*(F.lit(top * (i + 1) / thresholds) for i in range(thresholds))))
    return z.withColumn("threshold", levels).filter("z >= threshold").groupBy("rec", "threshold").agg(F.count(F.lit(1)).alias("n"))


def register_surrogates(spark, name: str = "surrogates") -> None:
    """Register the table function surrogates(rec_no, ch, times, duration_s, fs, n_rep, seed) -> (rep, t): the circularly shifted copies of one train
    that connectivity.surrogate_trains makes of it, for SQL users (FROM trains, LATERAL surrogates(...)). Null or empty times give no row."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="rep int, t double")
    class Surrogates:
        def eval(self, rec_no: int, ch: int, times: list, duration_s: float, fs: float, n_rep: int, seed: int):
            if not times:
                return
            n = int(duration_s * fs + 0.5)
            frames = [int(t * fs + 0.5) for t in times]
            for rep in range(1, n_rep + 1):
                h = 17
                for part in (seed, rec_no, ch, rep):
                    h = (h * 48271 + part * 69621 + 12345) % 2147483647
                by = (h * 48271 + 11) % 2147483647 % n + 1
                for frame in sorted({f + by - n if f + by > n else f + by for f in frames}):
                    yield rep, frame / fs

    spark.udtf.register(name, Surrogates)
