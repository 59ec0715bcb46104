"""Reading and writing the stored measurements: sessions, logs, transcripts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Buckets that the time-series store keeps for itself.
SYSTEM_BUCKETS = ("_tasks", "_monitoring")

SCHEMAS = {
    "speaker_recognition": "bucket string, _time timestamp, segment_start_time double, speakers string, similarities string, record_start_times string, durations string",
    "speaker_transcription": "bucket string, _time timestamp, chunk_start_time double, chunk_end_time double, text string, speaker string",
    "badge_translations": "bucket string, _time timestamp, segment_start_time double, translations string",
    "badge_rotations": "bucket string, _time timestamp, segment_start_time double, rotations string",
    "badge_relations": "bucket string, _time timestamp, segment_start_time double, graph string",
}


def session_name(bucket: Column) -> Column:
    """What follows the first underscore of a bucket's name, up to the next."""
    return F.split_part(bucket, F.lit("_"), F.lit(2))


def session_start(bucket: Column) -> Column:
    return F.try_to_timestamp(session_name(bucket))


def session_list(buckets: DataFrame) -> DataFrame:
    """Distinct buckets without the system's, with their start, in order of it (names that hold none come last)."""
    own = buckets.select("bucket").distinct().where(~F.col("bucket").isin(*SYSTEM_BUCKETS))
    return own.withColumn("start", session_start(F.col("bucket"))).orderBy(F.col("start").asc_nulls_last(), "bucket")


def widened(narrow: DataFrame, fields: list[str]) -> DataFrame:
    """Rows (bucket, _time, _field, _value) as one row for each time with a column for each field."""
    return narrow.groupBy("bucket", "_time").pivot("_field", fields).agg(F.first("_value", ignorenulls=True))


def session_scan(rows: DataFrame, bucket: str, key: str = "segment_start_time") -> DataFrame:
    """A session's rows from its start on, in order. The bucket picks the folder, and the start that its name tells is a
    constant before the plan is made: both filters reach the scan. A name without a start gives no bound."""
    start = F.coalesce(session_start(F.lit(bucket)), F.lit("0001-01-01").cast("timestamp"))
    return rows.where((F.col("bucket") == bucket) & (F.col("_time") >= start)).orderBy(key, "_time")


def session_rows(rows: DataFrame, buckets: DataFrame) -> DataFrame:
    """Rows of some sessions (bucket), each from its own start on. Folders of other sessions aren't read: the buckets,
    broadcast by their size, prune them while the query runs."""
    own = buckets.select("bucket", session_start(F.col("bucket")).alias("_start")).distinct()
    return rows.join(own, "bucket").where(F.col("_start").isNull() | (F.col("_time") >= F.col("_start"))).drop("_start")


def at_segments(rows: DataFrame, asked: DataFrame, horizon_s: int = 20) -> DataFrame:
    """Of each asked segment (bucket, segment_start_time) the first row with just that time, none if it was written more
    than the horizon before it."""
    near = asked.select("bucket", "segment_start_time").distinct()
    own = rows.join(near, ["bucket", "segment_start_time"]).where(F.unix_micros("_time") >= (F.floor("segment_start_time") - horizon_s) * 1_000_000)
    return own.groupBy("bucket", "segment_start_time").agg(F.min_by(F.struct("*"), "_time").alias("row")).select("row.*")


def as_of(asked: DataFrame, rows: DataFrame, time: str, horizon: float, *keys: str, then: str | None = None) -> DataFrame:
    """asked with the latest row of its keys at its time or before, as a struct ``row``: null if that is more than the
    horizon ago or there is none. Of rows at one time that with the largest ``then`` (a column of rows) is the latest; without
    it any of them.

    Both sides go through one sort of their keys by time (rows first where times tie), and each asked row takes the last
    row before it. A key with very many rows is one sorted pass over them, which spills; no pair of rows is formed."""
    tie = F.col(then) if then else F.lit(0)
    both = rows.select(*keys, F.col(time).alias("_at"), F.lit(0).alias("_side"), tie.alias("_then"), F.struct("*").alias("row")).unionByName(
        asked.select(*keys, F.col(time).alias("_at"), F.lit(1).alias("_side"), F.struct("*").alias("_asked")), allowMissingColumns=True)
    w = Window.partitionBy(*keys).orderBy("_at", "_side", "_then")
    last = F.last("row", ignorenulls=True).over(w)
    out = both.withColumn("row", last).where("_side = 1")
    return out.select("_asked.*", F.when(F.col(f"_asked.{time}") - F.col(f"row.{time}") <= horizon, F.col("row")).alias("row"))


def latest(rows: DataFrame, now: Column, horizon_s: int = 20) -> DataFrame:
    """The latest row of each bucket within the horizon before now; none if there is none."""
    recent = rows.where((F.col("_time") > now - F.make_dt_interval(secs=F.lit(horizon_s))) & (F.col("_time") <= now))
    return recent.groupBy("bucket").agg(F.max_by(F.struct("*"), "_time").alias("row")).select("row.*")


def read_log(spark: SparkSession, path: str, measurement: str) -> DataFrame:
    """A session log in JSON (a list of rows), of the live or the post-time dialect; the file names the bucket.

    Columns that a dialect lacks are null; its counters (segment_no, chunk_no) are kept as ``no``. A missing or broken
    file raises, as a silent gap would look like a quiet session."""
    want = T.StructType.fromDDL(SCHEMAS[measurement])
    # Nested values are JSON text in either dialect; whole-number times become doubles.
    read = T.StructType([f for f in want if f.name not in ("bucket",)] + [T.StructField("segment_no", T.LongType()), T.StructField("chunk_no", T.LongType())])
    rows = spark.read.schema(read).option("mode", "FAILFAST").json(path, multiLine=True)
    name = F.element_at(F.split(F.col("_metadata.file_path"), "/"), -1)
    bucket = F.regexp_extract(name, r"^(session_[^_]+)_", 1)
    return rows.select(bucket.alias("bucket"), *[f.name for f in want if f.name != "bucket"], F.coalesce("segment_no", "chunk_no").alias("no"))


def write_log(rows: DataFrame, path: str) -> None:
    """A measurement as JSON lines, a folder for each bucket."""
    rows.write.mode("append").partitionBy("bucket").json(path)


def append(rows: DataFrame, path: str) -> None:
    """Facts appended to a measurement's table, stamped with their arrival where they have none."""
    stamped = rows if "_time" in rows.columns else rows.withColumn("_time", F.current_timestamp())
    stamped.write.mode("append").partitionBy("bucket").parquet(path)


def upserted(rows: DataFrame) -> DataFrame:
    """One row for each bucket and time: a point written again replaces the one before (highest _seq, if given)."""
    order = F.col("_seq") if "_seq" in rows.columns else F.lit(0)
    return rows.groupBy("bucket", "_time").agg(F.max_by(F.struct("*"), order).alias("row")).select("row.*")


def parsed_recognition(rows: DataFrame) -> DataFrame:
    """The JSON columns as arrays; the raw speakers stay as speakers_json."""
    return rows.withColumns({
        "speakers_json": F.col("speakers"),
        "speakers": F.from_json("speakers", "array<string>"),
        "similarities": F.from_json("similarities", "array<double>"),
        "durations": F.from_json("durations", "array<double>"),
    })


def parsed_translations(rows: DataFrame) -> DataFrame:
    """A row for each badge seen: bucket, segment_start_time, badge, x, y, z and what else the rows carry."""
    places = rows.select("*", F.explode(F.from_json("translations", "map<string,array<array<double>>>")).alias("badge", "p"))
    return places.select(*[c for c in rows.columns if c != "translations"], "badge", *(F.col("p")[i][0].alias(a) for i, a in enumerate("xyz")))
