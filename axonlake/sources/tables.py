"""Sources and sinks: rosters, layouts, sampled data, cell types, stimulus files, metric tables."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_roster(spark: SparkSession, path: str, rows: tuple[int, int] | None = None) -> DataFrame:
    """CSV with a header line and columns name, age, group[, ground]: rec, div, grp, ground array<int>. rows: first and last line to read, the
    header being line 1. Blank or `nan` ground is an empty array."""
    lines = spark.sparkContext.textFile(path).zipWithIndex().toDF("line string, i long")  # line numbers of one small file
    lo, hi = rows or (2, 1 << 62)
    body = lines.filter((F.col("i") >= max(1, lo - 1)) & (F.col("i") <= hi - 1) & (F.trim("line") != ""))
    c = F.from_csv("line", "rec string, div string, grp string, ground string", {"quote": '"'})
    ground = F.when(F.lower(F.trim("c.ground")).isin("nan", "") | F.col("c.ground").isNull(), F.array().cast("array<int>"))
    return body.select(c.alias("c")).select(F.trim("c.rec").alias("rec"), F.col("c.div").try_cast("double").alias("div"), F.trim("c.grp").alias("grp"), ground.otherwise(F.transform(F.split("c.ground", ","), lambda x: F.trim(x).try_cast("int"))).alias("ground"))


def roster_problems(roster: DataFrame) -> DataFrame:
    """(code, n, example) of blank and repeated names, ages that are not numbers, blank groups, groups that start with a digit or hold odd characters."""
    blank = lambda c: F.coalesce(F.trim(c), F.lit("")) == ""
    tests = {
        "blank_name": blank(F.col("rec")), "bad_age": F.col("div").isNull(), "blank_group": blank(F.col("grp")),
        "group_starts_with_digit": F.coalesce(F.col("grp").rlike(r"^\d"), F.lit(False)), "group_characters": F.coalesce(F.col("grp").rlike(r"[^A-Za-z0-9_]"), F.lit(False)) & ~blank(F.col("grp")),
    }
    found = roster.select("rec", F.explode(F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in tests.items())))).alias("code"))
    twice = roster.groupBy("rec").agg(F.count(F.lit(1)).alias("k")).filter((F.col("k") > 1) & ~blank(F.col("rec"))).select("rec", F.lit("repeated_name").alias("code"))
    return found.unionByName(twice).groupBy("code").agg(F.count(F.lit(1)).alias("n"), F.min("rec").alias("example"))


def fill_metadata(roster: DataFrame, source: DataFrame) -> DataFrame:
    """Missing div and grp from another table: by equal name, else where one name is the other, a space and a suffix (the first such by name)."""
    s = source.select(F.col("rec").alias("src"), F.col("div").alias("sdiv"), F.col("grp").alias("sgrp"))
    exact = roster.join(s, F.col("rec") == F.col("src"), "left")
    done, open_ = exact.filter("src is not null"), exact.filter("src is null").select(*roster.columns)
    near = open_.join(s, F.expr("startswith(src, concat(rec, ' ')) or startswith(rec, concat(src, ' '))"), "left")
    first = near.withColumn("__rn", F.row_number().over(Window.partitionBy("rec").orderBy("src"))).filter("__rn = 1").drop("__rn")
    return done.unionByName(first).withColumns({"div": F.coalesce("div", "sdiv"), "grp": F.coalesce("grp", "sgrp")}).select(*roster.columns)


def age_of_name(name: Column) -> Column:
    return F.nullif(F.regexp_extract(name, r"(?i)DIV[\s_-]*(\d+)", 1), F.lit("")).cast("double")


def skeleton_roster(names: DataFrame) -> DataFrame:
    """(rec, div, grp, ground): a roster to be edited, of names (rec): ages where a name tells them, blank groups and no grounded electrodes; each
    name once, null and blank ones not at all."""
    rec = F.trim("rec")
    n = names.select(rec.alias("rec")).filter(F.col("rec") != "").distinct()
    return n.select("rec", age_of_name(F.col("rec")).alias("div"), F.lit("").alias("grp"), F.array().cast("array<int>").alias("ground"))


def plate_and_well(name: Column) -> Column:
    """struct(plate, well) of 'plate_A1' names; nulls for others."""
    pattern = r"^(.*)_([A-H])(\d{1,2})$"
    hit = name.rlike(pattern)
    return F.struct(F.when(hit, F.regexp_extract(name, pattern, 1)).alias("plate"), F.when(hit, F.concat(F.regexp_extract(name, pattern, 2), F.regexp_extract(name, pattern, 3))).alias("well"))


def electrode_id(col: Column, row: Column) -> Column:
    return col * 10 + row


def layout(spark: SparkSession, name: str) -> DataFrame:
    """(ch, x, y) of a named electrode layout, coordinates on 0..8. Grids are built from their rule."""
    n, drop_corners, gone = {"grid8": (8, False, ()), "grid4": (4, False, ()), "MCS60": (8, True, ()), "MCS59": (8, True, (82,))}[name]
    g = spark.range(1, n + 1).select(F.col("id").alias("c"), F.explode(F.sequence(F.lit(1), F.lit(n))).alias("r"))
    if drop_corners:
        g = g.filter(~(F.col("c").isin(1, n) & F.col("r").isin(1, n)))
    g = g.select(electrode_id(F.col("c"), F.col("r")).cast("int").alias("ch"), ((F.col("c") - 1) / (n - 1) * 8).alias("x"), ((n - F.col("r")) / (n - 1) * 8).alias("y"))
    return g.filter(~F.col("ch").isin(list(gone))) if gone else g


def interleaved_int16(spark: SparkSession, path: str, n_channels: int, scale: float, select: list[int] | None = None) -> DataFrame:
    """(frame, i, v) of frame-major int16 files without header: i is the channel's place, v = sample * scale. Each file is cut into blocks of
    whole frames by Spark's fixed-length record reader, so a file of any size is many tasks."""
    size = 2 * n_channels
    frames = spark.sparkContext.binaryRecords(path, size).zipWithIndex().toDF(T.StructType([T.StructField("raw", T.BinaryType()), T.StructField("frame", T.LongType())]))
    keep = list(range(n_channels)) if select is None else list(select)

    def run(batches):
        for pdf in batches:
            x = np.frombuffer(b"".join(pdf["raw"]), "<i2").reshape(-1, n_channels)[:, keep]
            yield pd.DataFrame({"frame": np.repeat(pdf["frame"].to_numpy(), len(keep)), "i": np.tile(keep, len(pdf)), "v": (x * scale).ravel().astype(float)})

    return frames.mapInPandas(run, "frame long, i int, v double")


def microvolts(counts: DataFrame, channel_info: DataFrame) -> DataFrame:
    """ADC counts to microvolts: (raw - adzero) * factor * 1e-6; the channel is the label's last token, `Ref` is 15."""
    last = F.element_at(F.split(F.trim("label"), r"\s+"), -1)
    info = channel_info.select("i", "adzero", "factor", F.when(last == "Ref", 15).otherwise(last.try_cast("int")).alias("ch"))
    return counts.join(F.broadcast(info), "i").select("rec", "ch", "frame", ((F.col("raw") - F.col("adzero")) * F.col("factor") * 1e-6).alias("v"))  # a device's channels


def save(df: DataFrame, path: str, by: str = "rec") -> None:
    df.write.mode("overwrite").partitionBy(by).parquet(path)


def load(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def durations(recordings: DataFrame) -> DataFrame:
    """duration_s and its source: the stored value if positive, else frames / fs, else null with source `unknown`, which callers leave out."""
    stored, counted = F.col("stored_s") > 0, (F.col("n_frames") > 0) & (F.col("fs") > 0)
    return recordings.withColumns({"duration_s": F.when(stored, F.col("stored_s")).when(counted, F.col("n_frames") / F.col("fs")), "source": F.when(stored, "stored").when(counted, "frames").otherwise("unknown")})


def consistent_imaging(counts: DataFrame) -> DataFrame:
    """counts (rec, part, n): (rec, ok, reason): number of units must agree over F, spks, iscell and rois; of the four peak arrays all or none."""
    core = F.col("part").isin("F", "spks", "iscell", "rois")
    g = counts.groupBy("rec").agg(F.count_distinct(F.when(core, F.col("n"))).alias("k"), F.count_distinct(F.when(core, F.col("part"))).alias("parts"), F.count_distinct(F.when(F.col("part").startswith("peak"), F.col("part"))).alias("peaks"))
    reason = F.when(F.col("parts") < 4, "missing part").when(F.col("k") > 1, "unit counts differ").when(~F.col("peaks").isin(0, 4), "incomplete peaks")
    return g.select("rec", reason.isNull().alias("ok"), reason.alias("reason"))


def cell_types(wide: DataFrame, rec: str = "rec") -> DataFrame:
    """(rec, roi, marker) of a wide table with a column per marker; what is not a number is dropped."""
    markers = [c for c in wide.columns if c != rec]
    long = wide.select(rec, *(F.col(m).cast("string").alias(m) for m in markers)).unpivot([rec], markers, "marker", "__v")
    return long.select(rec, F.col("__v").try_cast("double").try_cast("int").alias("roi"), "marker").filter("roi is not null")


def cell_groups(markers: DataFrame, rois: DataFrame, groups: dict[str, Column], known: list[str]) -> DataFrame:
    """(rec, ch, cell_group): each unit (ch = roi + 1) in every group whose predicate over the marker columns holds, else `Unassigned`."""
    m = markers.groupBy("rec", "roi").pivot("marker", known).agg(F.count(F.lit(1)))
    w = rois.join(m, ["rec", "roi"], "left").select("rec", (F.col("roi") + 1).alias("ch"), *((F.coalesce(F.col(f"`{k}`"), F.lit(0)) > 0).alias(k) for k in known))
    hit = F.array_compact(F.array(*(F.when(c, F.lit(n)) for n, c in groups.items())))
    return w.select("rec", "ch", F.explode(F.when(F.size(hit) > 0, hit).otherwise(F.array(F.lit("Unassigned")))).alias("cell_group"))


def external_stimuli(events: DataFrame, recordings: DataFrame) -> DataFrame:
    """(rec, ch, t, dur, blank zero) of events (raw, well, electrode, t, dur) matched by name raw_well."""
    return events.withColumn("rec", F.concat_ws("_", "raw", "well")).join(recordings.select("rec"), "rec", "left_semi").select("rec", F.col("electrode").alias("ch"), "t", "dur", F.col("t").alias("t0"), F.col("t").alias("t1"))


def metric_table(metrics: DataFrame, keys: list[str], names: list[str]) -> DataFrame:
    """Long metrics (keys, metric, value) as one row per key with the listed columns."""
    return metrics.groupBy(*keys).pivot("metric", names).agg(F.first("value"))


def write_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def to_nested(metrics: DataFrame) -> DataFrame:
    """(rec, json) with {lag: {metric: value}} of long metrics (rec, lag, metric, value); a recording's own metrics only."""
    lag = metrics.groupBy("rec", "lag").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("metric", "value")))).alias("m"))
    return lag.groupBy("rec").agg(F.to_json(F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.col("lag").cast("string").alias("lag"), F.to_json("m").alias("m")))))).alias("json"))


def from_nested(nested: DataFrame) -> DataFrame:
    lags = nested.select("rec", F.explode(F.from_json("json", "map<string,string>")).alias("lag", "m"))
    return lags.select("rec", F.col("lag").cast("int").alias("lag"), F.explode(F.from_json("m", "map<string,double>")).alias("metric", "value"))


def preview(df: DataFrame, rows: int = 20, columns: int = 10, width: int = 40) -> DataFrame:
    return df.select(*(F.substring(F.col(c).cast("string"), 1, width).alias(c) for c in df.columns[:columns])).limit(rows)


def imaging_folders(spark: SparkSession, root: str) -> DataFrame:
    """(rec, path, denoised) of folders under root that hold an imaging recording; file contents are not read."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root).select("path")
    hit = f.select(F.regexp_extract("path", r"^(.*/([^/]+))/suite2p/plane0/([^/]+)$", 1).alias("path"), F.regexp_extract("path", r"^(.*/([^/]+))/suite2p/plane0/([^/]+)$", 2).alias("rec"), F.regexp_extract("path", r"([^/]+)$", 1).alias("file")).filter("rec <> ''")
    return hit.groupBy("rec", "path").agg(F.max((F.col("file") == "stat.npy").cast("int")).alias("s"), (F.max(F.lower("file").contains("denoised").cast("int")) == 1).alias("denoised")).filter("s = 1").drop("s")
