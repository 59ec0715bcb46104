"""Measurements of group work made, by fixed recipes, from the generated tables.

Each recipe is stated once more as SQL in ``plans``; ids break all ties, so both engines agree on every order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def epoch_micros(ts: str = "ts") -> Column:
    return F.expr(f"timestampdiff(MICROSECOND, timestamp_ntz'1970-01-01 00:00:00', cast({ts} as timestamp_ntz))")


def entries(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket (a day), segment_start_time (ten-minute bins), speaker, duration, similarity, event_id, us, user_id."""
    speaker = F.when(F.col("event_type") == "error", "silent").when(F.col("event_type") == "signup", "unknown")
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "event_type", "value", "ts", epoch_micros().alias("us"))
    return e.select(
        F.concat(F.lit("session_"), F.date_format("ts", "yyyy-MM-dd")).alias("bucket"),
        (F.floor(F.col("us") / 600_000_000) * 600).cast("double").alias("segment_start_time"),
        F.coalesce(speaker, F.concat(F.lit("spk"), (F.col("user_id") % 5).cast("string"))).alias("speaker"),
        F.col("value").alias("duration"),
        (F.col("value") / 500).alias("similarity"),
        "event_id",
        "us",
        "user_id",
    )


def speaker_recognition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form: a row for each segment with JSON text in speakers, similarities and durations."""
    rows = entries(spark, sf_dir).groupBy("bucket", "segment_start_time").agg(
        F.array_sort(F.collect_list(F.struct("us", "event_id", "speaker", "duration", "similarity"))).alias("e")
    )
    text = lambda c: F.to_json(F.col(f"e.{c}"))
    return rows.select(
        "bucket",
        "segment_start_time",
        F.timestamp_micros(F.col("e")[0]["us"]).alias("_time"),
        text("speaker").alias("speakers"),
        text("similarity").alias("similarities"),
        text("duration").alias("durations"),
    )


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in the stored form: a segment for each turn, the system as silence."""
    c = read(spark, sf_dir, "conversations")
    speaker = F.when(F.col("role") == "system", "silent").otherwise(F.col("role"))
    return c.select(
        F.concat(F.lit("session_"), F.col("conv_id").cast("string")).alias("bucket"),
        F.col("turn").cast("double").alias("segment_start_time"),
        F.timestamp_seconds("turn").alias("_time"),
        F.to_json(F.array(speaker)).alias("speakers"),
        F.to_json(F.array(F.lit(1.0))).alias("similarities"),
        F.to_json(F.array(F.length("text").cast("double"))).alias("durations"),
        "text",
    )


def prop_k() -> Column:
    return F.get_json_object("props", "$.k").cast("double")


def sightings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket, badge, segment_start_time, x, y, z, event_id: a badge's position at each event."""
    e = read(spark, sf_dir, "events").withColumn("us", epoch_micros()).withColumn("k", prop_k())
    return e.select(
        F.concat(F.lit("session_"), F.date_format("ts", "yyyy-MM-dd")).alias("bucket"),
        (F.col("user_id") % 25).cast("string").alias("badge"),
        (F.col("us") / 1e6).alias("segment_start_time"),
        (F.col("value") / 10).alias("x"),
        (F.col("k") / 10).alias("y"),
        ((F.col("value") + F.col("k")) / 20).alias("z"),
        "event_id",
    )


def badge_translations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form: translations is JSON text {badge: [[x], [y], [z]]}."""
    s = sightings(spark, sf_dir)
    three = F.array(F.array("x"), F.array("y"), F.array("z"))
    return s.select("bucket", "segment_start_time", F.to_json(F.create_map("badge", three)).alias("translations"), "event_id")


def badge_rotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """bucket, badge, segment_start_time, r (3 x 3, about the y axis by k degrees), event_id."""
    e = read(spark, sf_dir, "events").withColumn("us", epoch_micros()).withColumn("a", F.radians(prop_k()))
    c, s, zero, one = F.cos("a"), F.sin("a"), F.lit(0.0), F.lit(1.0)
    return e.select(
        F.concat(F.lit("session_"), F.date_format("ts", "yyyy-MM-dd")).alias("bucket"),
        (F.col("user_id") % 25).cast("string").alias("badge"),
        (F.col("us") / 1e6).alias("segment_start_time"),
        F.array(F.array(c, zero, s), F.array(zero, one, zero), F.array(-s, zero, c)).alias("r"),
        "event_id",
    )


def badge_relations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored form: graph is JSON text {badge: [targets]}, one row an event; odd events have whole-number targets."""
    e = read(spark, sf_dir, "events").select("event_id", "user_id", "ts", epoch_micros().alias("us"))
    src, one, two = (F.pmod(F.col("user_id") + k, F.lit(25)).cast("string") for k in (0, 7, 11))
    loose = F.concat(F.lit('{"'), src, F.lit('":['), one, F.lit(","), two, F.lit("]}"))
    strict = F.concat(F.lit('{"'), src, F.lit('":["'), one, F.lit('","'), two, F.lit('","'), one, F.lit('"]}'))
    return e.select(
        F.concat(F.lit("session_"), F.date_format("ts", "yyyy-MM-dd")).alias("bucket"),
        (F.col("us") / 1e6).alias("segment_start_time"),
        F.when(F.col("event_id") % 2 == 1, loose).otherwise(strict).alias("graph"),
        "event_id",
    )


def base_results(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messages of three bases in order of arrival: bucket, arrival, base_id, record_time, speakers, similarities, durations."""
    return entries(spark, sf_dir).select(
        "bucket",
        F.col("event_id").alias("arrival"),
        F.concat(F.lit("b"), (F.col("user_id") % 3).cast("string")).alias("base_id"),
        (F.col("us") / 1e6).alias("record_time"),
        F.array("speaker").alias("speakers"),
        F.array("similarity").alias("similarities"),
        F.array("duration").alias("durations"),
    )


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vec_id, speaker and v (array of doubles)."""
    return read(spark, sf_dir, "embeddings").select("vec_id", F.concat(F.lit("s"), F.col("label").cast("string")).alias("speaker"), F.col("embedding").cast("array<double>").alias("v"))
