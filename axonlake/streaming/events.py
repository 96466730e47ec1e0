"""Streaming variants of the rate, session, refractory and interval-join operators, on Structured Streaming."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tumbling_counts(stream: DataFrame, width: str = "1 second", late: str = "10 seconds", time: str = "ts") -> DataFrame:
    """(rec, ch, start, n) per tumbling window; later rows than the watermark are dropped."""
    return stream.withWatermark(time, late).groupBy(F.window(time, width).alias("w"), "rec", "ch").agg(F.count(F.lit(1)).alias("n")).select("rec", "ch", F.col("w.start").alias("start"), "n")


def activity_sessions(stream: DataFrame, gap: str, least_events: int, least_channels: int, late: str = "10 seconds", time: str = "ts") -> DataFrame:
    """Gap-closed sessions of a recording with enough events and (approximately counted) channels."""
    s = stream.withWatermark(time, late).groupBy(F.session_window(time, gap).alias("w"), "rec").agg(F.count(F.lit(1)).alias("n"), F.approx_count_distinct("ch").alias("channels"))
    return s.filter((F.col("n") >= least_events) & (F.col("channels") >= least_channels)).select("rec", F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n", "channels")


def refractory_stream(stream: DataFrame, seconds: float, late: str = "10 seconds", time: str = "ts") -> DataFrame:
    """(rec, ch, time) of the events kept by the greedy refractory rule of each channel: an event is kept if it comes more than `seconds` after the
    last kept one.

    Events are held until the watermark has passed them, by an event-time timer of each channel, and then taken in order of time, so the
    result does not depend on how the stream is cut into micro-batches; rows up to `late` behind count like any other, later ones are dropped.
    Of equal times one is kept. A channel's state is what it holds and its last kept time, and ends once the watermark is past the
    refractory time of that. The session must use the RocksDB state store (use_rocksdb).
    """
    from pyspark.sql.streaming import StatefulProcessor

    apart = int(round(seconds * 1e6))
    kinds = {k: stream.schema[k].dataType.simpleString() for k in ("rec", "ch")}

    class Refractory(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.held = handle.getListState("held", "us long")
            self.last = handle.getValueState("last", "us long")

        def _wake(self, us: int) -> None:
            self.handle.registerTimer(-(-us // 1000))  # timers and the watermark count milliseconds

        def handleInputRows(self, key, rows, timerValues):
            import pandas as pd

            times = [t.value // 1000 for f in rows for t in pd.to_datetime(f[time].dropna())]
            if times:
                self.held.appendList([(us,) for us in times])
                self._wake(min(times))
            return iter(())

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
            import pandas as pd

            passed = timerValues.getCurrentWatermarkInMs() * 1000
            held = sorted({us for (us,) in self.held.get()}) if self.held.exists() else []
            last = self.last.get()[0] if self.last.exists() else None
            kept = []
            for us in held:
                if us > passed:
                    break
                if last is None or us > last + apart:
                    kept.append(us)
                    last = us
            left = [us for us in held if us > passed]
            self.held.clear()
            if left:
                self.held.put([(us,) for us in left])
                self._wake(left[0])
            if last is not None and (left or last + apart >= passed):
                self.last.update((last,))
                self._wake(last + apart + 1)
            else:
                self.last.clear()
            if kept:
                yield pd.DataFrame({"rec": [key[0]] * len(kept), "ch": [key[1]] * len(kept), time: pd.to_datetime(kept, unit="us")})

        def close(self) -> None:
            pass

    events = stream.withWatermark(time, late).select("rec", "ch", time)
    return events.groupBy("rec", "ch").transformWithStateInPandas(Refractory(), f"rec {kinds['rec']}, ch {kinds['ch']}, {time} timestamp", "Append", "EventTime")


def use_rocksdb(spark) -> None:
    """Have the session's streams keep their state in RocksDB, which timers and lists of state need."""
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


def responses(stim: DataFrame, events: DataFrame, window: str, late: str = "10 seconds") -> DataFrame:
    """Stimuli (rec, trial, stim_ts) with the events (rec, ch, ts) that follow within the window; both sides have watermarks."""
    s = stim.withWatermark("stim_ts", late).select(F.col("rec").alias("rec_"), "trial", "stim_ts")
    e = events.withWatermark("ts", late)
    near = F.expr(f"rec = rec_ and ts >= stim_ts and ts <= stim_ts + interval {window}")
    return s.join(e, near).select("rec", "trial", "ch", "stim_ts", "ts")
