"""Sources: pruned scans, point-in-time joins, replays, frames cut anywhere; and gazes after every message."""

import datetime
import os
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoke.functions import gates, signals
from convoke.functions import vectors as V
from convoke.operators import network, recognition
from convoke.sources import measurements as M
from convoke.sources import recordings as R
from convoke.streaming import gazing as G
from convoke.streaming.listening import STORE


def plan(df):
    return df._jdf.queryExecution().toString()


def stored(spark, path):
    rows = []
    for day in (1, 2, 3):
        for k in range(6):
            rows.append((f"session_2024-03-0{day}T10:00:00Z", datetime.datetime(2024, 3, day, 9, 58, tzinfo=datetime.UTC) + datetime.timedelta(minutes=k), float(10 - k), k))
    df = spark.createDataFrame(rows, "bucket string, _time timestamp, segment_start_time double, k int")
    M.append(df, path)
    return spark.read.parquet(path)


def test_session_scan(spark, tmp_path):
    rows = stored(spark, str(tmp_path / "m"))
    one = M.session_scan(rows, "session_2024-03-02T10:00:00Z")
    assert [r.k for r in one.collect()] == [5, 4, 3, 2]
    text = plan(one)
    scan = text[text.index("== Physical Plan ==") :]
    assert "PartitionFilters: [isnotnull(bucket" in scan and "session_2024-03-02T10:00:00Z" in scan
    assert "GreaterThanOrEqual(_time,2024-03-02" in scan.replace("`", "")
    M.append(rows.limit(1).select("_time", "segment_start_time", "k", F.lit("plain").alias("bucket")), str(tmp_path / "m"))
    assert M.session_scan(spark.read.parquet(str(tmp_path / "m")), "plain").count() == 1


def test_session_rows_prune(spark, tmp_path):
    rows = stored(spark, str(tmp_path / "m"))
    buckets = spark.createDataFrame([("session_2024-03-02T10:00:00Z", "b"), ("session_2024-03-03T10:00:00Z", "a")], "bucket string, room string")
    out = M.session_rows(rows, buckets.where("room = 'b'"))
    assert sorted(r.k for r in out.collect()) == [2, 3, 4, 5]
    assert "dynamicpruning" in plan(out).lower()


def test_at_segments(spark):
    t = lambda s: datetime.datetime.fromtimestamp(s, datetime.UTC)
    rows = spark.createDataFrame([("a", 100.0, t(101), "late"), ("a", 100.0, t(90), "first"), ("a", 100.0, t(79), "too old"), ("a", 130.5, t(100), "too old"), ("b", 100.0, t(100), "b")], "bucket string, segment_start_time double, _time timestamp, x string")
    asked = spark.createDataFrame([("a", 100.0), ("a", 130.5), ("a", 99.0), ("b", 100.0), ("b", 100.0)], "bucket string, segment_start_time double")
    assert sorted((r.bucket, r.x) for r in M.at_segments(rows, asked).collect()) == [("a", "first"), ("b", "b")]


def test_as_of(spark):
    rng = random.Random(1)
    rows = [(rng.choice("ab"), float(rng.randrange(300)), i) for i in range(80)]
    asked = [(rng.choice("abc"), float(rng.randrange(300)), i) for i in range(60)]
    a, r = spark.createDataFrame(asked, "k string, t double, i int"), spark.createDataFrame(rows, "k string, t double, x int")
    for row in M.as_of(a, r, "t", 20.0, "k").collect():
        near = [t for k, t, _ in rows if k == row.k and t <= row.t]
        assert (row.row and row.row.t) == (max(near) if near and row.t - max(near) <= 20 else None)
        assert row.row is None or (row.k, row.row.t, row.row.x) in rows
    assert M.as_of(a.limit(0), r, "t", 1.0, "k").count() == 0 and M.as_of(a, r.limit(0), "t", 1.0, "k").where("row is null").count() == 60


def test_as_of_ties(spark):
    rows = spark.createDataFrame([("a", 1.0 + i // 40, (i * 7) % 40) for i in range(80)], "k string, t double, x int").repartition(4)
    asked = spark.createDataFrame([("a", 1.0, 0), ("a", 1.5, 1), ("a", 2.0, 2)], "k string, t double, i int")
    assert [(r.row.t, r.row.x) for r in M.as_of(asked, rows, "t", 20.0, "k", then="x").orderBy("i").collect()] == [(1.0, 39), (1.0, 39), (2.0, 39)]


def test_logs_and_upserts(spark, tmp_path):
    rows = spark.createDataFrame([("b1", 5, 1.0, 0), ("b1", 5, 2.0, 1), ("b1", 6, 3.0, 0)], "bucket string, t long, segment_start_time double, _seq int").withColumn("_time", F.timestamp_seconds("t"))
    assert sorted(r.segment_start_time for r in M.upserted(rows).collect()) == [2.0, 3.0]
    assert M.upserted(rows.drop("_seq")).count() == 2
    (tmp_path / "logs").mkdir()
    (tmp_path / "logs" / "session_x1_translations.json").write_text('[{"segment_start_time": 3, "translations": "{}", "segment_no": 7}, {"segment_start_time": 4.5, "translations": "{}"}]')
    log = M.read_log(spark, str(tmp_path / "logs"), "badge_translations")
    assert sorted((r.bucket, r.segment_start_time, r.no) for r in log.select("bucket", "segment_start_time", F.coalesce("no", F.lit(0)).alias("no")).collect()) == [("session_x1", 3.0, 7), ("session_x1", 4.5, 0)]
    M.write_log(log, str(tmp_path / "out"))
    assert spark.read.json(str(tmp_path / "out")).count() == 2 and (tmp_path / "out" / "bucket=session_x1").is_dir()
    (tmp_path / "logs" / "session_x2_translations.json").write_text('[{"segment_start_time": ')
    with pytest.raises(Exception, match="(?i)malformed|failfast"):
        M.read_log(spark, str(tmp_path / "logs"), "badge_translations").collect()


def recorded(tmp_path):
    """Files with unpadded numbers, two of one time, and one that is no recording."""
    for k, (session, name, age) in enumerate([("s1", "a_9.wav", 50), ("s1", "a_10.wav", 60), ("s1", "b_2.wav", 50), ("s2", "x.wav", 10), ("s2", "a_1.wav", 5), ("s2", "notes.txt", 1)]):
        path = tmp_path / "rec" / session / name
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_bytes(b"x" * (k + 1))
        os.utime(path, (1_700_000_000 - age,) * 2)
    return str(tmp_path / "rec")


def test_replay(spark, tmp_path):
    files = R.recordings(spark, recorded(tmp_path))
    order = lambda by: {s: [r.name for r in R.replayed(files, by).orderBy("place").collect() if r.session == s] for s in ("s1", "s2")}
    assert order("modified") == {"s1": ["a_10.wav", "a_9.wav", "b_2.wav"], "s2": ["x.wav", "a_1.wav"]}
    assert order("no") == {"s1": ["b_2.wav", "a_9.wav", "a_10.wav"], "s2": ["a_1.wav", "x.wav"]}
    assert "content" not in plan(files.select("name")).split("ReadSchema")[-1]
    assert [(r.session, r.name) for r in R.log_of_session(files, ".wav").orderBy("session").collect()] == [("s1", "b_2.wav"), ("s2", "x.wav")]
    assert R.log_of_session(files, "_recognition.json").count() == 0
    seen = []
    stream = R.recordings(spark, str(tmp_path / "rec"), stream=True)
    query = stream.writeStream.foreachBatch(lambda df, _: seen.extend(r.name for r in df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    assert seen[0] == "a_10.wav" and set(seen[1:3]) == {"a_9.wav", "b_2.wav"} and seen[3:] == ["x.wav", "a_1.wav"]


def test_frames(spark, tmp_path):
    spark.dataSource.register(R.Frames)
    want = []
    (tmp_path / "f").mkdir()
    for name, counters in (("one", [5, 6, 9, 10, 2**32 - 1, 1]), ("two", [0, 1])):
        data = b""
        for k, c in enumerate(counters):
            pcm = np.arange(k, k + 512, dtype=np.int16).tobytes()
            want.append((name, k * R.FRAME, c, datetime.datetime(2024, 2, 29, 23, 59, k, 7000), pcm))
            data += R.HEADER.pack(c, 2024, 2, 29, 23, 59, k, 7) + pcm
        (tmp_path / "f" / name).write_bytes(data + b"cut short")
    for size in (100, 1041, 1042, 5000, 1 << 20):
        df = spark.read.format("frames").option("splitBytes", str(size)).load(str(tmp_path / "f"))
        got = [(os.path.basename(r.path), r.at, r.counter, r.time, bytes(r.pcm)) for r in df.withColumn("time", F.col("time").cast("timestamp_ntz")).collect()]
        assert sorted(got) == sorted(want)
    lost = [(os.path.basename(r.path), r.after, r.lost) for r in R.gaps(df).orderBy("after").collect()]
    assert lost == [("one", 6, 2), ("one", 10, 2**32 - 12), ("one", 2**32 - 1, 1)]
    assert spark.read.format("frames").load(str(tmp_path / "f" / "two")).count() == 2


def test_frame_rate(spark):
    frames = [("a", k * 0.1) for k in range(65)] + [("b", 1.0)]
    got = R.frame_rate(spark.createDataFrame(frames, "source string, time double"), 30).orderBy("no").collect()
    assert [(r.source, r.no, round(r.fps, 6)) for r in got] == [("a", 0, round(30 / 2.9, 6)), ("a", 1, 10.0)]


def test_small_forms(spark):
    tags = spark.createDataFrame([("3",), ("12",), ("13",), ("x",), (None,)], "tag string")
    assert sorted(r.tag for r in network.known_tags(tags, 12).collect()) == ["12", "3"]
    one = spark.range(1).select(network.tag_centre(F.lit([[0.0, 0.0], [10.0, 0.0], [10.0, 21.0], [0.0, 21.0]]), F.lit(30), F.lit(100)).alias("c")).first().c
    assert one == [0.1667, 0.105]
    loud = spark.createDataFrame([(0.1, 0.9), (0.4, 0.6)], "rms double, peak double")
    assert [round(r[0], 9) for r in loud.select(gates.stand_in(F.col("rms"), F.col("peak"), 0.2, 0.5, 0.4)).collect()] == [0.2, 0.48]
    quiet = loud.select(gates.weighted(F.lit(0.5), F.col("rms"), 0.2).alias("w")).collect()
    assert [round(r.w, 6) for r in quiet] == [round(0.5 * np.log(0.1) / np.log(0.2), 6), round(0.5 * np.log(0.4) / np.log(0.2), 6)]


def test_faces_and_signals(spark):
    right, turned = [[1.0, 0.0, 0.6], [0.0, 1.0, 0.0], [0.0, 0.0, 0.8]], [[1.0, 0.0, -0.6], [0.0, 1.0, 0.0], [0.0, 0.0, -0.8]]
    df = spark.createDataFrame([(1, right), (2, turned)], "i int, r array<array<double>>").withColumn("t", F.lit([0.0, 1.0, 2.0]))
    normal, mended = V.facing(F.col("r"), F.col("t"))
    got = {r.i: (r.n, r.m) for r in df.select("i", normal.alias("n"), mended.alias("m")).collect()}
    # The axis that points to the camera is the face's own direction, and the orientation is turned back.
    assert got[1] == ([-0.6, -0.0, -0.8], right) and got[2] == ([-0.6, 0.0, -0.8], [[1.0, 0.0, 0.6], [0.0, 1.0, -0.0], [0.0, 0.0, 0.8]])
    rows = {r.i: (r.x, r.z, round(r.nx, 9), round(r.nz, 9)) for r in network.gaze_rows(df, detected=True).collect()}
    assert rows[1] == rows[2] == (0.0, 2.0, -0.6, -0.8)
    assert {r.i: round(r.nx, 9) for r in network.gaze_rows(df).collect()} == {1: -0.6, 2: 0.6}
    x = spark.createDataFrame([([16384, -32768, 0], [1.5, -0.25, -2.0])], "a array<int>, b array<double>")
    assert tuple(x.select(signals.to_float(F.col("a")), signals.to_int16(F.col("b"))).first()) == ([0.5, -1.0, 0.0], [32767, -8191, -32767])
    part = spark.createDataFrame([([float(i) for i in range(10)], [(0.0, 0.2), (0.5, 0.8)])], "x array<double>, r array<struct<start: double, end: double>>")
    assert part.select(signals.joined_ranges(F.col("x"), F.col("r"), 10).alias("y")).first().y == [0.0, 1.0, 5.0, 6.0, 7.0]
    w = signals.cut(spark.createDataFrame([(1, [0.0] * 4 + [3.0, 4.0])], "i int, x array<double>"), 1000, 2, db=0.0).orderBy("no").collect()
    assert [r.x for r in w[:2]] == [[0.0, 0.0]] * 2 and np.allclose(w[2].x, np.array([3.0, 4.0]) / np.sqrt(12.5))


def test_library_loads_up_to_the_first_failure(spark):
    rows = [("ann", 0, [1.0, 0.0]), ("ann", 1, [0.0, 2.0]), ("bob", 2, [3.0, 0.0]), ("cy", 3, [1.0, 0.0]), ("cy", 4, None), ("dee", 5, [1.0, 0.0])]
    df = spark.createDataFrame(rows, "speaker string, place int, v array<double>")
    assert {r.speaker: (r.centroid, r.n) for r in recognition.loaded(df).collect()} == {"ann": ([0.5, 0.5], 2), "bob": ([1.0, 0.0], 1)}
    assert recognition.loaded(df.where("v is not null")).count() == 4


def looks(rng, n, seconds):
    """Messages of some tags each, and of badges that look for themselves."""
    rows, arrival = [], 0
    for _ in range(n):
        arrival += 1
        t = 100 + arrival * seconds / 7
        if rng.random() < 0.2:
            rows.append(("b", t, arrival, rng.choice("123"), None, None, None, None, [rng.choice("456")]))
            continue
        for tag in rng.sample("123456", rng.randrange(1, 4)):
            a = rng.random() * 6.28
            rows.append(("b", t, arrival, tag, rng.random() * 2, rng.random() * 2, np.cos(a).item(), np.sin(a).item(), rng.choice([None, [], [rng.choice("789")]])))
    return rows


LOOKS = "bucket string, time double, arrival long, tag string, x double, z double, nx double, nz double, targets array<string>"


def from_scratch(rows):
    """Each window's graph, all pairs of all tags tried anew after every message."""
    out = {}
    for w in sorted({int(r[1]) for r in rows}):
        places, graph = {}, {}
        for arrival in sorted({r[2] for r in rows if int(r[1]) == w}):
            message = [r for r in rows if r[2] == arrival]
            places.update({r[3]: r[4:8] for r in message if r[4] is not None})
            for r in message:
                if r[8] is not None:
                    graph.setdefault(r[3], []).extend(r[8])
            for tag, (x, z, nx, nz) in places.items():
                graph.setdefault(tag, [])
                for other, (ox, oz, _, _) in places.items():
                    far = ((x - ox) ** 2 + (z - oz) ** 2) ** 0.5
                    if other != tag and other not in graph[tag] and 0 < far <= 1.2 and (nx * (x - ox) + nz * (z - oz)) / far < -0.7:
                        graph[tag].append(other)
        out |= {(w, tag): targets for tag, targets in graph.items()}
    return out


def test_gazes_after_every_message(spark, tmp_path):
    for k, v in STORE.items():
        spark.conf.set(k, v)
    rng = random.Random(7)
    rows = looks(rng, 60, 1)
    want = from_scratch(rows)
    assert sum(len(t) for t in want.values()) > 40
    source, seen, arrivals = tmp_path / "in", [], sorted({r[2] for r in rows})
    late = [("b", 10_000.0 + k * 1000, 10_000 + k, "1", 0.0, 0.0, 1.0, 0.0, None) for k in range(2)]
    files = [[r for r in rows if r[2] in arrivals[i : i + 9]] for i in range(0, len(arrivals), 9)] + [[r] for r in late]
    for no, part in enumerate(files):
        spark.createDataFrame(part, LOOKS).coalesce(1).write.parquet(str(source / f"{no:03}"))
    stream = spark.readStream.schema(LOOKS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
    graphs = G.gaze_stream(G.messages_of(stream), late="1 second")
    query = graphs.writeStream.foreachBatch(lambda df, _: seen.extend(df.collect())).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    query.awaitTermination()
    got = {(r.window, r.tag): r.targets for r in seen if r.window < 10_000}
    assert got == want
    # The batch form has the same edges, but for those that messages brought themselves.
    alone = [(*r[:8], None) for r in rows if r[4] is not None]
    batch = network.looked_so_far(spark.createDataFrame([(int(r[1]), *r[2:8]) for r in alone], "window long, arrival long, tag string, x double, z double, nx double, nz double"), 1.2, -0.7)
    edges = {(r.window, r.tag, r.target) for r in batch.collect()}
    assert edges == {(w, tag, t) for (w, tag), targets in from_scratch(alone).items() for t in targets}
    assert query.lastProgress["stateOperators"][0]["numRowsTotal"] <= 6
