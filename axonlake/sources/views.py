"""The driver's tables seen as event, network and activity data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: 2024-01-01 in microseconds, and the span of the event table in seconds.
START_US, SPAN_S = 1_704_067_200_000_000, 2_592_000.0


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spikes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, ch, t, value): event type as recording, user modulo 16 as channel."""
    e = table(spark, sf_dir, "events")
    return e.select(F.col("event_type").alias("rec"), (F.col("user_id") % 16).alias("ch"), ((F.unix_micros(F.col("ts").cast("timestamp")) - START_US) / 1e6).alias("t"), "value")


def recordings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, rec_no, duration_s): one row per event type."""
    e = table(spark, sf_dir, "events").select(F.col("event_type").alias("rec")).distinct()
    return e.select("rec", F.length("rec").cast("long").alias("rec_no"), F.lit(SPAN_S).alias("duration_s"))


def channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recordings(spark, sf_dir).select("rec", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(15).cast("long"))).alias("ch"))


def supplier_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(rec, src, dst, w): suppliers joined by the number of parts that both shipped, one network per return flag and year."""
    li = table(spark, sf_dir, "lineitem").select(F.concat("l_returnflag", F.year("l_shipdate").cast("string")).alias("rec"), "l_partkey", "l_suppkey")
    li = li.repartition("rec", "l_partkey").distinct()  # dealt once, for the join too
    b = li.select("rec", "l_partkey", F.col("l_suppkey").alias("dst"))
    return li.join(b, ["rec", "l_partkey"]).filter("l_suppkey < dst").groupBy("rec", F.col("l_suppkey").alias("src"), "dst").agg(F.count(F.lit(1)).cast("double").alias("w"))


def frames(spark: SparkSession, sf_dir: str, units: int = 64) -> DataFrame:
    """(rec, frame, roi, f): vector number as frame, dimension as unit, label as recording."""
    e = table(spark, sf_dir, "embeddings")
    return e.select(F.col("label").alias("rec"), F.col("vec_id").alias("frame"), F.posexplode("embedding").alias("roi", "f")).withColumn("f", F.col("f").cast("double")).filter(F.col("roi") < units)
