"""Interval, band and as-of joins on time, as equi-joins over time buckets with an exact condition on top.

A band join puts each row of one side into the buckets its band touches, so cost follows the number of near pairs; the join key is
(keys, bucket), which spreads a busy recording over its duration. As-of joins are one window over the union of both sides.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def band_pairs(left: DataFrame, right: DataFrame, keys: list[str], lo: Column | float, hi: Column | float, width: float, t_left: str = "t", t_right: str = "t_right", closed: str = "both", how: str = "inner") -> DataFrame:
    """Rows of left with rows of right where t_right lies in [t + lo, t + hi] (closed='both') or [t + lo, t + hi) ('left').

    width is the bucket width and should be about hi - lo. right must name its time t_right and share only `keys` with left.
    how: inner, left, left_semi or left_anti.
    """
    lo, hi = (F.lit(x) if isinstance(x, (int, float)) else x for x in (lo, hi))
    first, last = F.floor((F.col(t_left) + lo) / width), F.floor((F.col(t_left) + hi) / width)
    l = left.withColumns({"__lo": F.col(t_left) + lo, "__hi": F.col(t_left) + hi}).withColumn("__b", F.explode(F.sequence(first, last)))
    r = right.withColumn("__b", F.floor(F.col(t_right) / width))
    below = (F.col(t_right) <= F.col("__hi")) if closed == "both" else (F.col(t_right) < F.col("__hi"))
    on = [l[k] == r[k] for k in keys] + [l["__b"] == r["__b"], F.col(t_right) >= F.col("__lo"), below]
    cond = on[0]
    for c in on[1:]:
        cond = cond & c
    if how in ("left_semi", "left_anti"):
        hit = l.join(r, cond, "left_semi").select(*left.columns).distinct()
        return left.join(hit, left.columns, how)
    pairs = l.join(r, cond).select(*(l[c] for c in left.columns), *(r[c] for c in right.columns if c not in keys))
    if how == "inner":
        return pairs
    return left.join(pairs, left.columns, "left")


def as_of(left: DataFrame, right: DataFrame, keys: list[str], value: str, t: str = "t", strict: bool = True, forward: bool = False) -> DataFrame:
    """left with `value` of the latest right row before t (at t too if not strict); forward: of the earliest after it. Null if none.

    right has keys, t and value, with value not null.
    """
    side = F.lit(0 if strict == (not forward) else 1)
    l = left.withColumns({"__v": F.lit(None).cast(right.schema[value].dataType), "__s": side, "__l": F.struct(*left.columns)})
    r = right.select(*keys, t, F.col(value).alias("__v"), (F.lit(1) - side).alias("__s"), F.lit(None).cast(l.schema["__l"].dataType).alias("__l"))
    order = (F.desc(t), F.desc("__s")) if forward else (t, "__s")  # latest row first: a frame up to the current row only grows
    pick = F.last("__v", ignorenulls=True).over(Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    both = l.select(*keys, t, "__v", "__s", "__l").unionByName(r)
    return both.withColumn("__p", pick).filter("__l is not null").select("__l.*", F.col("__p").alias(value))


def merge_intervals(intervals: DataFrame, keys: list[str], start: str = "t0", end: str = "t1") -> DataFrame:
    """Overlapping or touching intervals merged: keys, start, end."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    run = F.sum(F.when(before.isNull() | (F.col(start) > before), 1).otherwise(0)).over(w)
    return intervals.withColumn("__r", run).groupBy(*keys, "__r").agg(F.min(start).alias(start), F.max(end).alias(end)).drop("__r")


def outside_intervals(rows: DataFrame, intervals: DataFrame, keys: list[str], t: str = "t") -> DataFrame:
    """Rows whose t is in no closed interval [t0, t1] of their keys: intervals are merged, so one as-of look-up decides."""
    merged = merge_intervals(intervals, keys).select(*keys, F.col("t0").alias(t), F.struct("t0", "t1").alias("__i"))
    return as_of(rows, merged, keys, "__i", t=t, strict=False).filter("__i is null or " + t + " > __i.t1").drop("__i")


def new_and_missing(wanted: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Incremental work: keys of `wanted` with status done or missing, and keys of `done` no longer wanted as stale."""
    w, d = wanted.select(key).distinct(), done.select(key).distinct()
    return (
        w.join(d, key, "left_semi").withColumn("status", F.lit("done"))
        .unionByName(w.join(d, key, "left_anti").withColumn("status", F.lit("missing")))
        .unionByName(d.join(w, key, "left_anti").withColumn("status", F.lit("stale")))
    )


def first_root(found: DataFrame, key: str, priority: str) -> DataFrame:
    """One row per key, from the root of the lowest priority number."""
    w = Window.partitionBy(key).orderBy(priority)
    return found.withColumn("__rn", F.row_number().over(w)).filter("__rn = 1").drop("__rn")
