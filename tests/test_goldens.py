"""Hand-computed cases of FIXTURES.md, randomised sessions against a plain model, and streams against batches."""

import json
import math
import random
import time

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoke.functions import gates, signals, text
from convoke.functions import vectors as V
from convoke.operators import alignment, motion, network, recognition, speech, transform_paths
from convoke.plans.sessions import rounded_score
from convoke.streaming import segments as streams


def session(spark, rows, bucket="session_a"):
    data = [(bucket, float(3 * i), i, json.dumps(s), json.dumps([1.0] * len(s)), json.dumps(d)) for i, (s, d) in enumerate(rows)]
    df = spark.createDataFrame(data, "bucket string, segment_start_time double, k int, speakers string, similarities string, durations string")
    return df.withColumn("_time", F.timestamp_seconds("k")).drop("k")


G1 = [(["A"], [3]), (["silent"], [3]), (["silent"], [3]), (["B"], [2]), (["A", "B"], [2, 3]), (["silent"], [3]), (["unknown"], [3]), (["B"], [3])]


def test_g1(spark):
    rows = session(spark, G1)
    m = speech.conversation_metrics(rows).first()
    assert (m.n, m.apd, m.nttc) == (7, 4.5, 2 / 7) and math.isclose(m.peq, 0.9) and math.isclose(m.sr, 9 / 22)
    e = speech.interactions(rows).collect()
    assert [(r.src, r.dst, r.weight) for r in e] == [("A", "B", 0.125)]
    assert {r.speaker: r.seconds for r in speech.speaking_time(rows).collect()} == {"A": 5, "B": 8, "silent": 9, "unknown": 3}
    one = speech.conversation_metrics(session(spark, G1[:1])).first()
    assert (one.apd, one.peq, one.nttc, one.sr) == (0, None, 0, 0)
    assert speech.conversation_metrics(session(spark, [(["unknown2"], [1])])).count() == 0


def test_interactions_of_crowded_rows(spark):
    # 60,000 entries a row: as pairs of entries they would be 3.6 billion for each two rows.
    crowd, other = (["A"] * 40_000 + ["B"] * 20_000, [1]), (["B"] * 30_000 + ["C", "silent"], [1])
    e = speech.interactions(session(spark, [crowd, other, crowd, (["silent"], [1]), crowd]))
    want = {("B", "A"): 12e8, ("C", "A"): 4e4, ("C", "B"): 2e4, ("A", "B"): 12e8, ("A", "C"): 4e4, ("B", "C"): 2e4}
    assert {(r.src, r.dst): r.weight for r in e.collect()} == {k: c / 5 for k, c in want.items()}


def model(rows):
    """Conversation metrics by walking over the rows."""
    rows = [r for r in rows if "unknown" not in json.dumps(r[0])]
    n = len(rows)
    if n <= 1:
        return (n, 0.0, None, 0.0, 0.0) if n else None
    silence = total = pause = pauses = turns = flushed = 0
    count = {}
    for i, (s, d) in enumerate(rows):
        after = rows[i + 1][0] if i + 1 < n else None
        for who, sec in zip(s, d, strict=True):
            total += sec
            if who == "silent":
                silence += sec
                pause += sec
                if after is None or "silent" not in after:
                    flushed += pause
                    pauses += 1
                    pause = 0
            else:
                count[who] = count.get(who, 0) + 1
            if after is not None and who not in after and "silent" not in after:
                turns += 1
    x = list(count.values())
    peq = 1 - sum(abs(a - b) for a in x for b in x) / (2 * len(x) ** 2 * (sum(x) / len(x))) if x else None
    return n, (flushed / pauses if pauses else 0.0), peq, turns / n, (silence / total if silence else 0.0)


def test_random_sessions(spark):
    rng = random.Random(11)
    every, want = None, {}
    for k in range(25):
        rows = []
        for _ in range(rng.randrange(1, 10)):
            s = [rng.choice(["A", "B", "C", "silent", "unknown"][: rng.randrange(3, 6)]) for _ in range(rng.randrange(1, 4))]
            rows.append((s, [rng.randrange(1, 4) for _ in s]))
        if model(rows):
            want[f"session_{k}"] = model(rows)
        df = session(spark, rows, f"session_{k}")
        every = df if every is None else every.unionByName(df)
    got = {r.bucket: (r.n, r.apd, r.peq, r.nttc, r.sr) for r in speech.conversation_metrics(every).collect()}
    assert got.keys() == want.keys()
    for k, v in want.items():
        assert all((a is None) == (b is None) and (a is None or math.isclose(a, b, abs_tol=1e-9)) for a, b in zip(got[k], v, strict=True)), (k, got[k], v)


def test_g2(spark):
    g = [("s", '{"0":["1","1"],"1":[0]}'), ("s", '{"0":["0","2"],"25":["1"],"2":["0"]}')]
    e = network.physical_interactions(spark.createDataFrame(g, "bucket string, graph string")).cache()
    assert {(r.src, r.dst): r.weight for r in e.collect()} == {("0", "1"): 1.0, ("0", "2"): 0.5, ("2", "0"): 0.5}
    assert {(r.src, r.dst) for r in network.reciprocal(e).collect()} == {("0", "2"), ("2", "0")} and {(r.src, r.dst) for r in network.one_way(e).collect()} == {("0", "1")}
    assert {r.node: r.strength for r in network.strengths(e).collect()} == {"0": 1.5, "1": 0.0, "2": 0.5}


def test_g3_g4(spark):
    p = [("s", "5", 0.0, 0, 0.0, 0.0, 0.0), ("s", "25", 0.0, 1, 1.0, 0.0, 0.0), ("s", "5", 1.0, 2, 3.0, 4.0, 0.0), ("s", "5", 2.0, 3, 3.0, 4.0, 12.0), ("s", "25", 2.0, 4, 1.0, 0.0, 2.0)]
    p = spark.createDataFrame(p, "bucket string, badge string, segment_start_time double, event_id int, x double, y double, z double")
    assert {r.badge: r.movement for r in motion.translate_movement(p).collect()} == {"5": 17.0, "25": 2.0}
    one, turn = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]], [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    r = spark.createDataFrame([("s", "5", float(i), i, m) for i, m in enumerate([one, turn, turn])], "bucket string, badge string, segment_start_time double, event_id int, r array<array<double>>")
    assert math.isclose(motion.rotate_movement(r).first().movement, 90)
    far = spark.createDataFrame([([[1.1, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]],)], "r array<array<double>>")
    a, b = far.select(V.angle(F.col("r")), V.angle(F.col("r"), True)).first()
    assert math.isnan(a) and b == 0


def pieces_by_loop(times, gap=1.5):
    out, start = [], 0
    for i in range(1, len(times) + 1):
        if i == len(times) or times[i] - times[i - 1] > gap:
            if len(set(times[start:i])) < 2:
                continue
            out.append((times[start], times[i - 1], i - start))
            start = i
    return out


def test_g5_and_random_paths(spark):
    rng = random.Random(4)
    cases = [[0, 1, 5, 9, 10, 11, 20], [0, 5, 10, 15], [0, 5, 10]] + [list(np.cumsum([rng.choice([0, 1, 1, 2, 3]) for _ in range(rng.randrange(1, 12))]).tolist()) for _ in range(60)]
    rows = [("s", str(k), float(t), i) for k, ts in enumerate(cases) for i, t in enumerate(ts)]
    got = {}
    for r in motion.trajectory_pieces(spark.createDataFrame(rows, "bucket string, badge string, segment_start_time double, event_id int")).orderBy("badge", "piece").collect():
        got.setdefault(int(r.badge), []).append((r.start, r.finish, r.points))
    for k, ts in enumerate(cases):
        assert got.get(k, []) == pieces_by_loop(ts), ts


G6 = [("b1", 100.7), ("b2", 101.2), ("b1", 103.8), ("b1", 106.9), ("b2", 106.5), ("b2", 102.0), ("b1", 113.0)]
G6_WANT = [(100.0, "b1", 1), (100.0, "b2", 2), (103.8, "b1", 3), (103.8, "b2", 5), (106.9, "b1", 4)]


def test_g6_batch_and_stream(spark, tmp_path):
    rows = [("s", i + 1, b, r) for i, (b, r) in enumerate(G6)]
    df = spark.createDataFrame(rows, "bucket string, arrival long, base_id string, record_time double")
    assert sorted((r.segment, r.base_id, r.arrival) for r in alignment.aligned(df, 2).collect()) == sorted(G6_WANT)
    assert (113.0, "b1", 7) in [(r.segment, r.base_id, r.arrival) for r in alignment.aligned(df, 2, flush=True).collect()]
    for i, part in enumerate((df.where("arrival <= 3"), df.where("arrival > 3"))):
        part.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        del i
    stream = spark.readStream.schema(df.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = streams.aligned_stream(stream, 2).writeStream.format("memory").queryName("g6").outputMode("append").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "ck")).start()
    q.awaitTermination(120)
    got = sorted((r.segment, r.base_id, r.arrival) for r in spark.table("g6").collect())
    assert got == sorted(G6_WANT)


def test_g7(spark):
    rows = session(spark, [(["A"], [3]), (["A", "B"], [3, 3]), (["B"], [3]), (["silent"], [3])])
    chunks = speech.speaker_chunks(rows, 3.0).orderBy("no").collect()
    assert [(r.speaker, r.chunk_start, r.chunk_end) for r in chunks] == [("A", 0, 6), ("B", 3, 9), ("silent", 9, 12)]
    c = spark.createDataFrame([("s", "A", 0, 3, 1), ("s", "B", 3, 3, 2), ("s", "A", 3, 6, 3), ("s", "C", 6, 9, 4)], "bucket string, speaker string, chunk_start int, chunk_end int, no int")
    assert [(r.speaker, r.chunk_start, r.chunk_end) for r in speech.merged_chunks(c).orderBy("run").collect()] == [("A", 0, 6), ("C", 6, 9)]


def test_g8(spark):
    one = spark.range(1)
    got = one.select(
        text.overlap_percent(F.lit("The cat ran"), F.lit("the cat sat.")), text.overlap_percent(F.lit("x"), F.lit("")), text.clock_of_day(F.lit(3725.0), F.lit(0.0)),
        text.parsed_actions(F.lit("{'1' : 'Reading', '7' : 'Writing'}")), text.parsed_actions(F.lit("1: Reading\n2: Writing")), text.clock(F.lit(90061)), text.capitalised(F.lit("aNNA LEE")), text.seconds_of(F.lit("1:02:03.5")),
    ).first()
    assert math.isclose(got[0], 200 / 3) and list(got)[1:] == [0.0, "01:02:05", {"1": "Reading", "7": "Writing"}, {"1": "Reading\n2"}, "25:01:01", "Anna lee", 3723.5]
    lines = spark.createDataFrame([("s", 1, "Anna  00:00:03  00:00:09"), ("s", 2, "hello"), ("s", 3, "Unknown  00:00:09"), ("s", 4, "mm"), ("s", 5, "Ben  00:12")], "session string, no int, line string")
    assert [r.rttm for r in text.rttm(lines).orderBy("no").collect()] == ["SPEAKER s 1 3.000000 6.000000 <NA> <NA> Anna <NA> <NA>", "SPEAKER s 1 12.000000 10.000000 <NA> <NA> Ben <NA> <NA>"]
    assert text.spoken_text(lines).first().text == "hello mm " and text.spoken_text(lines, True).first().text == "hello "


def test_g9(spark):
    edges = spark.createDataFrame([tuple(e.split("-")) for e in ("a-m", "b-c", "c-b", "b-a", "c-m", "e-b")], "src string, dst string")
    assert sorted(r.path for r in transform_paths.paths(edges, "b", "m").collect()) == ["b-a,a-m", "b-c,c-b,b-a,a-m", "b-c,c-m"]
    turn = [[0.0, -1.0, 0.0], [1.0, 0.0, 0.0], [0.0, 0.0, 1.0]]
    t = spark.createDataFrame([("a", "m", turn, [1.0, 0.0, 0.0]), ("b", "a", turn, [0.0, 1.0, 0.0])], "src string, dst string, r array<array<double>>, t array<double>")
    got = {r.start: r for r in transform_paths.exported(t, "m").collect()}
    assert np.allclose(got["b"].r, np.array(turn) @ np.array(turn)) and np.allclose(got["b"].t, np.array(turn) @ [0, 1, 0] + [1, 0, 0])


def test_g10(spark):
    reg = spark.createDataFrame([("P", [2.0, 0.0]), ("Q", [0.0, 5.0])], "speaker string, v array<double>")
    lib = recognition.centroids(reg).cache()
    best = recognition.recognised(spark.createDataFrame([(1, [3.0, 4.0])], "vec_id long, v array<double>"), lib, 2).first()
    assert best.speaker == "Q" and math.isclose(best.similarity, 0.8)
    named = lib.withColumn("library", F.lit("x"))
    after = {r.speaker: r for r in recognition.updated(named, spark.createDataFrame([("x", 1, [3.0, 4.0])], "library string, vec_id long, v array<double>")).collect()}
    assert np.allclose(after["Q"].centroid, [0.3, 0.9]) and after["Q"].n == 2
    asked = spark.createDataFrame([(1, [3.0, 4.0], "unknown", ["P", "unknown"]), (2, [3.0, 4.0], "unknown", ["silent"])], "vec_id long, v array<double>, origin string, candidates array<string>")
    assert sorted((r.vec_id, r.speaker, round(r.similarity, 6)) for r in recognition.recognised_among(asked, lib, 0.7).collect()) == [(1, "unknown", 0.6), (2, "unknown", 0.0)]
    with pytest.raises(Exception, match="not registered"):
        recognition.recognised_among(asked.withColumn("candidates", F.array(F.lit("Z"))), lib, 0.7).collect()


def test_g11(spark):
    tags = lambda z, x=0.0: spark.createDataFrame([(1, "1", 0.0, 0.0, 0.0, -1.0), (1, "2", x, z, 1.0, 0.0)], "window int, tag string, x double, z double, nx double, nz double")
    assert ("1", "2") in [(r.tag, r.target) for r in network.looks_at(tags(-1.0), 1.2, -0.94).collect()]
    assert network.looks_at(tags(-1.3), 1.2, -0.7).count() == 0 and network.looks_at(tags(0.0), 1.2, -0.7).count() == 0


def test_looks_in_a_crowded_window(spark):
    # One window, 20,000 messages of three tags: rows that never held together must not meet, so there is no join.
    rng, rows, places, want = random.Random(3), [], {}, {}
    for arrival in range(20_000):
        tag, x, z = rng.choice("abc"), rng.choice([None, 0.0, 0.5, 1.5, 9.0]), rng.choice([0.0, 0.7, 1.4])
        nx, nz = rng.choice([(1.0, 0.0), (-1.0, 0.0), (0.0, 1.0)])
        rows.append(("w", arrival, tag, x, z, nx, nz))
        places[tag] = x, z, nx, nz
        for one in places:
            for two in places:
                (ax, az, anx, anz), (bx, bz, _, _) = places[one], places[two]
                if one != two and ax is not None and bx is not None:
                    far = math.sqrt((ax - bx) ** 2 + (az - bz) ** 2)
                    if 0 < far <= 1.2 and (anx * (ax - bx) + anz * (az - bz)) / far < -0.7:
                        want.setdefault((one, two), arrival)
    out = network.looked_so_far(spark.createDataFrame(rows, "window string, arrival long, tag string, x double, z double, nx double, nz double"), 1.2, -0.7)
    assert {(r.tag, r.target): r.since for r in out.collect()} == want and len(want) == 6
    assert "Join" not in out._jdf.queryExecution().executedPlan().toString()


def by_lists(messages, bases, expiry, reach):
    """Segments by looking through all that are open."""
    latest, held, out = None, [], []
    for base, r, m in messages:
        if latest is None:
            latest = float(int(r))
            held.append((latest, [(base, m)]))
            continue
        out += [s for s in held if r - s[0] > expiry]
        held = [s for s in held if r - s[0] <= expiry]
        near = [s for s in held if abs(r - s[0]) <= reach and base not in [b for b, _ in s[1]]]
        if near:
            mine = min(near, key=lambda s: s[0])
            mine[1].append((base, m))
        elif latest > r:
            continue
        else:
            latest, mine = r, (r, [(base, m)])
            held.append(mine)
        if len(mine[1]) >= bases:
            out.append(mine)
            held.remove(mine)
    return out, held


@pytest.mark.parametrize("expiry,reach", [(5.0, 3.0), (2.0, 3.0), (40.0, 10.0)])
def test_segments_as_lists(expiry, reach):
    rng = random.Random(5)
    messages = [(rng.choice("abcde"), max(0.0, i / 20 + rng.choice([0, 0, 1, -4, 6])), i) for i in range(3000)]
    state, out = alignment.Segments(4, expiry, reach), []
    for m in messages:
        out += state.add(*m)
    assert (out, state.open) == by_lists(messages, 4, expiry, reach)


def test_many_open_segments():
    # One base alone: every message opens a segment, and 60,000 stay open.
    state = alignment.Segments(3, 1e9, 1e9)
    began = time.process_time()
    for i in range(60_000):
        assert state.add("b0", float(i), i) == []
    assert len(state.open) == 60_000 and time.process_time() - began < 20


def test_four_decimals(spark):
    rows = spark.createDataFrame([(0, None), (1, 0.25), (2, 0.12345)], "k int, x double").select("k", gates.four_decimals(F.col("x")).alias("s"))
    assert [r.s for r in rows.orderBy("k").collect()] == ["0", "0.2500", "0.1235"]


def test_signals(spark):
    x = np.sin(np.arange(64) / 5)
    assert np.allclose(signals.resample(x, 1, 1, "fourier"), x) and len(signals.resample(x, 2, 1)) == 32
    assert np.allclose(signals.resample(x, 1, 1, "lanczos"), x) and np.allclose(signals.resample(np.ones(20), 1, 2, "lanczos"), 1)
    at = np.linspace(0, 1, 50)
    cubic = lambda u: 2 * u**3 - u**2 + 3 * u - 1
    assert np.allclose(motion.not_a_knot(cubic(np.linspace(0, 1, 7)), at), cubic(at))
    one = spark.createDataFrame([([1.0, 2.0, 3.0, 4.0, 5.0],)], "x array<double>")
    assert one.select(signals.shifted(F.col("x"), 2)).first()[0] == [4.0, 5.0, 1.0, 2.0, 3.0]
    assert [r.x for r in signals.cut(one, 1000, 2).collect()] == [[1.0, 2.0], [3.0, 4.0]]
    assert abs(np.sqrt((signals.normalised(x) ** 2).mean()) - 0.1) < 1e-9 and (signals.noisy(x, 20, 1) == signals.noisy(x, 20, 1)).all()


def made(node, name):
    """Rows that a plan's nodes of that name gave, once it ran."""
    kind = node.nodeName().split(" ")[0]
    below = [node.executedPlan()] if kind == "AdaptiveSparkPlan" else [node.plan()] if kind.endswith("QueryStage") else [node.children().apply(i) for i in range(node.children().size())]
    return sum(made(x, name) for x in below) + (node.metrics().apply("numOutputRows").value() if kind == name else 0)


def test_looks_at_shuffles_few_copies(spark):
    """A tag goes to three strips at most, not to all squares of its sector."""
    rng = random.Random(2)
    rows = [("w", str(i), rng.uniform(0, 40), rng.uniform(0, 40), math.cos(i), math.sin(i)) for i in range(300)]
    found = network.looks_at(spark.createDataFrame(rows, "window string, tag string, x double, z double, nx double, nz double"), 5.0, -0.7)
    assert found.collect() and len(rows) <= made(found._jdf.queryExecution().executedPlan(), "Generate") <= 3 * len(rows)


def test_looks_at_by_sectors(spark):
    """Every pair that brute force finds, at any bound; and no broadcast, which leaves the pairs to the tasks that read."""
    rng = random.Random(5)
    rows = [(f"w{i % 3}", f"t{i}", rng.uniform(-9, 9), rng.uniform(-9, 9), *(rng.choice([0.3, 0.7, 1.0, 2.5]) * f(a) for f in (math.cos, math.sin))) for i, a in enumerate(rng.choice([k * math.pi / 8, rng.uniform(0, 7)]) for k in range(240))]
    rows += [("w0", "same", *rows[0][2:]), ("w0", "far", 1e12, 3.0, 1.0, 0.0), ("w0", "lost", math.inf, 0.0, 1.0, 0.0), ("w0", "nan", math.nan, 0.0, 1.0, 0.0), ("w0", "none", None, 0.0, 1.0, 0.0), ("w0", "flat", 1.0, 1.0, 0.0, 0.0), ("w0", "square", 5.0, 5.0, 1.0, 0.0), ("w0", "edge", 10.0, 5.0, -1.0, 0.0)]
    df = spark.createDataFrame(rows, "window string, tag string, x double, z double, nx double, nz double").repartition(3)
    for cosine in (-0.94, -0.7, 0.0, 0.5):
        expected = {}
        for w, tag, x, z, nx, nz in rows:
            for v, other, ox, oz, _, _ in rows:
                if w != v or tag == other or None in (x, ox) or not math.isfinite(x + ox):
                    continue
                far = math.sqrt((x - ox) * (x - ox) + (z - oz) * (z - oz))
                if 0 < far <= 5 and (nx * (x - ox) + nz * (z - oz)) / far < cosine:
                    expected[w, tag, other] = (nx * (x - ox) + nz * (z - oz)) / far
        found = network.looks_at(df, 5.0, cosine)
        assert [r[:3] for r in sorted(found.collect())] == sorted(expected) and {tuple(r[:3]): r.score for r in found.collect()} == expected
        assert "BroadcastHashJoin" not in found._jdf.queryExecution().executedPlan().toString()


def test_scores_round_as_duckdb(spark):
    """Half a unit in the product, not in the decimal text, as DuckDB takes it."""
    import duckdb

    values = [-0.700005, -0.850015, -1.0, -0.7000000001, -0.712345, -0.999995, *(-random.Random(i).randrange(70_000, 100_000) / 1e5 - 5e-6 for i in range(2000))]
    got = [r.score for r in rounded_score(spark.createDataFrame([(v,) for v in values], "score double")).collect()]
    assert got == [duckdb.execute("select round(?::double, 5)", [v]).fetchone()[0] for v in values]


def test_unit_finds_the_length_once(spark):
    """Work in step with the numbers of a vector, not with their square."""
    rows = [([float((i * k) % 7 - 3) for k in range(6000)],) for i in range(24)] + [([0.0, 0.0],), ([],), (None,), ([3.0, None],)]
    df = spark.createDataFrame(rows, "v array<double>").repartition(1)
    start = time.monotonic()
    got = {None if r.v is None else tuple(r.v): r.u for r in df.select("v", V.unit(F.col("v")).alias("u")).collect()}
    assert time.monotonic() - start < 15
    assert got[0.0, 0.0] == [None, None] and got[3.0, None] == [None, None] and got[None] is None and got[()] == []
    v = rows[1][0]
    n = math.sqrt(sum(x * x for x in v))
    assert got[tuple(v)] == [x / n for x in v]
