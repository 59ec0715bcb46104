"""Streams of segments, windows and sections against plain walks, stopped and started again; sinks written once."""

import datetime
import random

from pyspark.sql import functions as F

from convoke.operators import alignment
from convoke.streaming import segments as S


def run(spark, tmp_path, rows, schema, sizes, start, restart=1):
    """rows in files of these sizes, shuffled within each; the query is stopped after some of them and started again."""
    rng, low, source = random.Random(3), 0, tmp_path / "in"
    for no, size in enumerate(sizes):
        part = rows[low : low + size]
        low += size
        rng.shuffle(part)
        spark.createDataFrame(part, schema).coalesce(1).write.parquet(str(source / f"{no:03}"))
        if no in (restart, len(sizes) - 1):
            stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
            query = start(stream).option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
            assert query.awaitTermination(120)
    return query


def test_aligned_as_batch(spark, tmp_path):
    rng = random.Random(5)
    rows, t = [], 100.0
    for i in range(120):
        t += rng.choice([0.1, 0.5, 2.5])
        rows.append((rng.choice("st"), i, rng.choice(["b0", "b1", "b2"]), t - rng.choice([0.0, 0.0, 4.0])))
    schema, seen = "bucket string, arrival long, base_id string, record_time double", []
    start = lambda s: S.aligned_stream(s, 2).writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect())))
    run(spark, tmp_path, list(rows), schema, [30, 30, 30, 30], start)
    assert sorted(seen) == sorted(map(tuple, alignment.aligned(spark.createDataFrame(rows, schema), 2).collect())) and len(seen) > 40


def test_changed_sections(spark, tmp_path):
    rng = random.Random(6)
    now = datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC)
    rows = [(rng.choice("st"), rng.choice("xy"), i, rng.choice(["A", "A", "B", None]), now) for i in range(80)]
    schema, seen = "bucket string, section string, arrival long, key string, ts timestamp", []
    start = lambda s: S.changed_sections(s, "key").writeStream.foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect())))
    run(spark, tmp_path, list(rows), schema, [20, 20, 40], start)
    last, want = {}, []
    for r in rows:
        if r[:2] not in last or last[r[:2]] != r[3]:
            want.append(r)
        last[r[:2]] = r[3]
    assert sorted(repr(r[:4]) for r in seen) == sorted(repr(r[:4]) for r in want)


def test_windows_as_batch(spark, tmp_path):
    rng = random.Random(7)
    at = lambda i: datetime.datetime(2024, 1, 1, tzinfo=datetime.UTC) + datetime.timedelta(milliseconds=i * 150)
    rows = [("s", i, at(i), rng.choice("78"), float(i), 0.0, 1.0, [str(i)]) for i in range(60)]
    schema = "bucket string, arrival long, ts timestamp, badge string, x double, y double, z double, targets array<string>"
    seen = []
    start = lambda s: S.windows_stream(s, late="1 second").writeStream.outputMode("append").foreachBatch(lambda df, _: seen.extend(map(tuple, df.collect())))
    far = ("end", 99, at(10_000), "7", 0.0, 0.0, 0.0, [])
    run(spark, tmp_path, [*rows, far], schema, [20, 40, 1], start)
    batch = alignment.windows(spark.createDataFrame(rows, schema).withColumn("us", F.unix_micros("ts")))
    assert sorted(seen) == sorted(map(tuple, batch.collect()))


def test_sink_once(spark, tmp_path):
    rows = [(f"session_{k % 2}", k) for k in range(10)]
    spark.createDataFrame(rows, "bucket string, k int").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("bucket string, k int").parquet(str(tmp_path / "in"))
    for _ in range(2):
        S.to_sink(stream(), str(tmp_path / "facts"), str(tmp_path / "c")).awaitTermination()
    assert sorted(map(tuple, spark.read.parquet(str(tmp_path / "facts")).select("bucket", "k").collect())) == sorted(rows)
    assert (tmp_path / "facts" / "bucket=session_1").is_dir()
