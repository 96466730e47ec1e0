import os
import random
import struct
import time

import pytest
from pyspark.sql import functions as F

from axonlake.operators import connectivity, events
from axonlake.sources import tables
from axonlake.streaming import events as stream


def test_roster(spark, tmp_path):
    p = tmp_path / "roster.csv"
    p.write_text('name,age,group,ground\nA DIV14,14,WT,"3, 15"\nB,x,2HE,\nC,21,,nan\nB,7,K-O,1\n')
    r = tables.read_roster(spark, f"file://{p}")
    got = {(x.rec, x.div): (x.grp, x.ground) for x in r.collect()}
    assert got["A DIV14", 14.0] == ("WT", [3, 15]) and got["B", None] == ("2HE", []) and got["C", 21.0][1] == []
    assert tables.read_roster(spark, f"file://{p}", (3, 4)).count() == 2
    codes = {x.code: x.n for x in tables.roster_problems(r).collect()}
    assert codes == {"bad_age": 1, "blank_group": 1, "group_starts_with_digit": 1, "group_characters": 1, "repeated_name": 1}
    names = spark.createDataFrame([("x_DIV 21",), ("plate_B12",), ("plain",)], "n string")
    assert [x.a for x in names.select(tables.age_of_name(F.col("n")).alias("a")).collect()] == [21.0, None, None]
    assert [tuple(x.w) for x in names.select(tables.plate_and_well(F.col("n")).alias("w")).collect()] == [(None, None), ("plate", "B12"), (None, None)]


def test_interleaved_and_nested(spark, tmp_path):
    p = tmp_path / "plate.raw"
    p.write_bytes(struct.pack("<12h", *range(12)))
    got = sorted((r.frame, r.i, r.v) for r in tables.interleaved_int16(spark, f"file://{p}", 3, 0.5, [0, 2]).collect())
    assert got == [(f, i, (3 * f + i) * 0.5) for f in range(4) for i in (0, 2)]
    m = spark.createDataFrame([("a", 10, "Dens", 0.5), ("a", 10, "Q", 0.1), ("a", 25, "Q", 0.2), ("b", 10, "Q", 0.3)], "rec string, lag int, metric string, value double")
    assert sorted(map(tuple, tables.from_nested(tables.to_nested(m)).select(*m.columns).collect())) == sorted(map(tuple, m.collect()))
    assert tables.layout(spark, "MCS59").count() == 59 and tables.layout(spark, "grid4").count() == 16


def run(df, name):
    q = df.writeStream.format("memory").queryName(name).outputMode("append").trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def source(spark, path):
    rows = [("r", i % 3, f"2024-01-01 00:00:{i % 60:02d}.{i % 7}") for i in range(120)] + [("r", 0, "2024-01-01 01:00:00")]
    df = spark.createDataFrame(rows, "rec string, ch long, s string").select("rec", "ch", F.to_timestamp("s").alias("ts"))
    df.coalesce(1).write.parquet(path)
    return spark.readStream.schema(df.schema).parquet(path), df


def test_streams_match_batches(spark, tmp_path):
    s, b = source(spark, str(tmp_path / "a"))
    got = {(r.ch, r.start): r.n for r in run(stream.tumbling_counts(s), "p1").collect()}
    want = {(r.ch, r.w.start): r.n for r in b.groupBy("ch", F.window("ts", "1 second").alias("w")).agg(F.count(F.lit(1)).alias("n")).collect()}
    assert all(want[k] == n for k, n in got.items()) and len(got) >= len(want) - 1
    assert run(stream.activity_sessions(s, "5 seconds", 50, 3), "p2").first().n == 120
    stim = s.filter("ch = 1").select("rec", F.lit(1).alias("trial"), F.col("ts").alias("stim_ts"))
    near = run(stream.responses(stim, s.filter("ch = 2"), "2 seconds"), "p4").count()
    left, right = b.filter("ch = 1").select("rec", F.col("ts").alias("st")), b.filter("ch = 2").select("rec", "ts")
    assert near == left.join(right, "rec").filter("ts >= st and ts <= st + interval 2 seconds").count()


def thin(times, seconds):
    """The greedy refractory rule on one channel's times in microseconds."""
    kept = []
    for us in sorted(set(times)):
        if not kept or us > kept[-1] + seconds * 1e6:
            kept.append(us)
    return kept


@pytest.mark.parametrize("cut", ["one", "five", "late"])
def test_refractory_stream_equals_the_batch_rule_under_any_cut(spark, tmp_path, cut):
    """All events in one micro-batch, in five by time, and in many where neighbours in time are batches apart (within the watermark's delay)."""
    r = random.Random(3)
    rows = sorted((r.randrange(0, 60_000_000), r.randrange(3)) for _ in range(500)) + [(10_000_000, 1)] * 2
    batches = {"one": [rows], "five": [rows[k * 101 : (k + 1) * 101] for k in range(5)], "late": [[] for _ in range(6)]}[cut]
    if cut == "late":
        for us, ch in rows:
            batches[min(5, max(0, us // 10_000_000 + r.choice([-1, 0, 0, 1])))].append((us, ch))
    assert sorted(x for b in batches for x in b) == sorted(rows)
    path = tmp_path / "in"
    schema = "us long, ch long, rec string"
    for k, b in enumerate([*batches, [(3_600_000_000, 9)], [(3_700_000_000, 9)]]):  # what comes much later lets the watermark pass
        spark.createDataFrame([(us, ch, "r") for us, ch in b], schema).coalesce(1).write.mode("append").parquet(str(path))
        os.utime(path)
        time.sleep(0.05)
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    stream.use_rocksdb(spark)
    try:
        s = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(path)).select("rec", "ch", F.timestamp_micros("us").alias("ts"))
        got = run(stream.refractory_stream(s, 0.4, "30 seconds"), f"thin_{cut}").select("ch", F.unix_micros("ts").alias("us")).collect()
    finally:
        if before:
            spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)
        else:
            spark.conf.unset("spark.sql.streaming.stateStore.providerClass")
    for ch in range(3):
        assert sorted(x.us for x in got if x.ch == ch) == thin([us for us, c in rows if c == ch], 0.4)


def test_surrogate_table_function_equals_the_batch_operator(spark):
    r = random.Random(8)
    rows = [(rec, ch, float(t)) for rec in "ab" for ch in range(3) for t in r.sample(range(1, 400), 12)]
    spikes = spark.createDataFrame(rows, "rec string, ch long, t double")
    recs = spark.createDataFrame([("a", 1, 400.0), ("b", 2, 400.0)], "rec string, rec_no long, duration_s double")
    want = sorted(map(tuple, connectivity.surrogate_trains(spikes, recs, 5, 2.0, 7).select("rec", "ch", "rep", "t").collect()))
    events.register_surrogates(spark)
    spikes.groupBy("rec", "ch").agg(F.collect_list("t").alias("times")).join(recs, "rec").createOrReplaceTempView("trains")
    got = spark.sql("SELECT rec, ch, s.rep, s.t FROM trains, LATERAL surrogates(rec_no, ch, times, duration_s, 2.0D, 5, 7) s")
    assert sorted(map(tuple, got.collect())) == want
    assert spark.sql("SELECT * FROM surrogates(1L, 1L, array(), 10.0D, 1.0D, 3, 1)").count() == 0
