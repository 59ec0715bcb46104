"""Camera pairs: batch against a plain loop, streams against batch, upserts replayed, versions read anew."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoke.operators import pairing as P
from convoke.operators.transform_paths import quaternion, rotation
from convoke.streaming import cameras as C
from convoke.streaming.listening import STORE


def turn(axis, degrees):
    q = np.append(np.array(axis, float) / np.linalg.norm(axis) * math.sin(math.radians(degrees) / 2), math.cos(math.radians(degrees) / 2))
    return rotation(q)


def sightings(rng, n=300, pairs=2):
    """Tags before two cameras; the other one's system is turned and moved; now and then a sighting is far off."""
    rows, between = [], (turn([1, 2, 0], 40), np.array([1.0, -2.0, 0.5]))
    for p in range(pairs):
        t = 10.0 * (p + 1)
        for i in range(n):
            t += rng.choice([0.002, 0.005, 0.03])
            camera, tag = rng.choice(["m", "o", "o", "m", "third"]), rng.choice("789")
            r, x = turn([rng.random(), 1, rng.random()], rng.random() * 90), np.array([rng.random() * 3 for _ in range(3)])
            # Both cameras see the tag of one short while in one place.
            still = random.Random(f"{p}{tag}{int(t * 10)}")
            r, x = turn([still.random(), 1, still.random()], still.random() * 90), np.array([still.random() * 3 for _ in range(3)])
            if camera == "o":
                r, x = between[0].T @ r, between[0].T @ (x - between[1])
                r, x = turn([0, 0, 1], rng.gauss(0, 0.5)) @ r, x + rng.gauss(0, 0.01)
                if rng.random() < 0.15:
                    x = x + 0.5
            rows.append((f"p{p}", tag, i, t, camera, "m", "o", r.tolist(), x.tolist()))
    return rows


def loop(rows, tolerance, top, metres, degrees):
    """Message by message: old positions of all tags go, then the tag's own is set, then its pair counts."""
    out = []
    for pair in sorted({r[0] for r in rows}):
        seen, held = {"m": {}, "o": {}}, []
        for _, tag, arrival, t, camera, _, _, r, x in sorted((r for r in rows if r[0] == pair), key=lambda r: r[2]):
            for s in seen.values():
                for old in [k for k, v in s.items() if t - v[0] > tolerance]:
                    del s[old]
            if camera in seen:
                seen[camera][tag] = (t, np.array(r), np.array(x))
            if tag in seen["m"] and tag in seen["o"]:
                (_, rm, tm), (_, ra, ta) = seen["m"][tag], seen["o"][tag]
                own = rm @ np.linalg.inv(ra)
                held = [*held, (quaternion(own), tm - own @ ta)][-top:]
                q, mean = np.mean([h[0] for h in held], axis=0), np.mean([h[1] for h in held], axis=0)
                m = np.linalg.norm(rotation(q) @ ta + mean - tm)
                d = math.degrees(math.acos(np.clip((np.trace(rotation(q) @ ra @ rm.T) - 1) / 2, -1, 1)))
                if kept := not (m > metres or d > degrees):
                    pass
                else:
                    held.pop()
                out.append((pair, tag, arrival, mean, m, d, kept, len(held)))
    return out


def same(got, want):
    got, want = (sorted(x, key=lambda r: (r[0], r[2])) for x in (got, want))
    assert [(*g[:3], *g[6:]) for g in got] == [(*w[:3], *w[6:]) for w in want]
    for g, w in zip(got, want, strict=True):
        assert np.allclose([*g[3], g[4]], [*w[3], w[4]], atol=1e-9) and math.isclose(g[5], w[5], abs_tol=1e-4)


def columns(df):
    return [(r["pair"], r.tag, r.arrival, r.t, r.metres, r.degrees, r.kept, r.n) for r in df.collect()]


@pytest.mark.parametrize("top", [5, 5000])
def test_batch_as_loop(spark, top):
    rows = sightings(random.Random(top))
    df = spark.createDataFrame(rows, P.SIGHTINGS).repartition(3)
    want = loop(rows, 0.02, top, 0.1, 3.0)
    assert len(want) > 40 and 0.4 < np.mean([w[6] for w in want]) < 1
    same(columns(P.averaged(P.paired(df, 0.02), top)), want)


def test_sums_taken_anew(monkeypatch):
    rng = random.Random(4)
    monkeypatch.setattr(P.Average, "RENEWED", 7)
    one, two = P.Average(top=6), P.Average(top=6)
    two.RENEWED = 10**9
    for _ in range(60):
        args = turn([1, 1, 0], rng.random()).tolist(), [rng.random() / 50] * 3, turn([0, 1, 0], rng.random()).tolist(), [0.0, 1.0, rng.random() / 20]
        a, b = one.add(*args), two.add(*args)
        assert np.allclose(a["t"], b["t"]) and (a["kept"], a["n"]) == (b["kept"], b["n"])


def test_inverses_are_taken_in_batches(spark, monkeypatch):
    # A row by itself would call add.
    monkeypatch.setattr(P.Average, "add", lambda *_: 1 / 0)
    rows = sightings(random.Random(9), pairs=3)
    same(columns(P.averaged(P.paired(spark.createDataFrame(rows, P.SIGHTINGS).repartition(3), 0.02), 5)), loop(rows, 0.02, 5, 0.1, 3.0))


def test_quaternions():
    rng = random.Random(3)
    for _ in range(200):
        r = turn([rng.gauss(0, 1) for _ in range(3)], rng.random() * 360)
        q = quaternion(r)
        assert np.allclose(rotation(q), r) and q[np.argmax(np.abs(q))] > 0


def run(spark, source, tmp_path, name, rows, size, start, restart_after=None):
    """rows in files of some rows, in order but shuffled within, through the stream that start() builds."""
    rng = random.Random(5)
    files = [rows[i : i + size] for i in range(0, len(rows), size)]
    cuts = [0, restart_after or len(files), len(files)]
    for low, high in zip(cuts, cuts[1:], strict=False):
        for no in range(low, high):
            part = list(files[no])
            rng.shuffle(part)
            spark.createDataFrame(part, P.SIGHTINGS).coalesce(1).write.parquet(str(source / f"{no:03}"))
        if high > low:
            stream = spark.readStream.schema(P.SIGHTINGS).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
            query = start(stream).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start()
            query.awaitTermination()
    return query.lastProgress["stateOperators"]


def test_stream_as_batch(spark, tmp_path):
    for k, v in STORE.items():
        spark.conf.set(k, v)
    rows = sightings(random.Random(1), n=90, pairs=2)
    rows.sort(key=lambda r: (r[3], r[2]))
    # Sightings of others long after make the timers of all tags and pairs run.
    far = [("later", "1", i, 5000.0 + 1000 * i, "third", "m", "o", np.eye(3).tolist(), [0.0] * 3) for i in range(3)]
    seen = []
    pairs = lambda s: C.paired_stream(s, 0.02)
    start = lambda s: C.averaged_stream(pairs(s), top=6).writeStream.foreachBatch(lambda df, _: seen.extend(columns(df)))
    every = [*rows, *far]
    state = run(spark, tmp_path / "in", tmp_path, "state", every[: len(rows)] + far, 45, start, 2)
    same(seen, columns(P.averaged(P.paired(spark.createDataFrame(rows, P.SIGHTINGS), 0.02), 6)))
    # Nothing of the first sessions is left: their positions and means were given up.
    assert sum(s["numRowsTotal"] for s in state) <= 8


def averages(spark, *rows):
    one = [[1.0, 0.0, 0.0], [0.0, 1.0, 0.0], [0.0, 0.0, 1.0]]
    return spark.createDataFrame([(p, "7", arrival, 1.0, one, [x, 0.0, 0.0], 0.0, 0.0, kept, 1) for p, arrival, x, kept in rows], P.AVERAGED)


def test_upsert_replayed(spark, tmp_path):
    path = str(tmp_path / "transforms")
    put = C.upsert(path)
    now = lambda: {r["pair"]: (r.t[0], r.arrival) for r in C.stored(spark, path).collect()}
    assert now() == {} and C.versions(spark, path) == []
    put(averages(spark, ("a", 1, 0.1, True), ("a", 2, 0.2, True), ("a", 3, 9.0, False), ("b", 1, 0.5, True)), 0)
    assert now() == {"a": (0.2, 2), "b": (0.5, 1)}
    put(averages(spark, ("a", 4, 0.4, True)), 1)
    # The batch comes again, with other rows even: nothing changes.
    put(averages(spark, ("a", 4, 7.0, True), ("c", 1, 1.0, True)), 1)
    assert now() == {"a": (0.4, 4), "b": (0.5, 1)} and C.versions(spark, path) == [1, 2]
    # A version without its mark was broken off: readers pass over it, the batch writes it again.
    averages(spark, ("a", 1, 1.0, True)).write.parquet(C.version_path(path, 3))
    (tmp_path / "transforms" / "version=000000000003" / "_SUCCESS").unlink()
    assert now()["a"] == (0.4, 4)
    put(averages(spark, ("b", 9, 0.9, True)), 2)
    assert now() == {"a": (0.4, 4), "b": (0.9, 9)}
    put(averages(spark, ("b", 9, 8.0, False)), 3)
    assert now() == {"a": (0.4, 4), "b": (0.9, 9)} and C.versions(spark, path) == [2, 3, 4]


def test_validation_reads_each_version(spark, tmp_path):
    path, one = str(tmp_path / "transforms"), np.eye(3).tolist()
    rows = [("a", "7", i, float(i), one, [1.0, 0.0, 0.0], turn([0, 1, 0], 10).tolist(), [0.0, 0.0, 0.0]) for i in range(3)]
    pairs = [spark.createDataFrame([r], P.PAIRED) for r in rows]
    out = {}
    check = C.validate(path, lambda df, i: out.update({i: [(r.arrival, r.metres and round(r.metres, 6), r.degrees and round(r.degrees, 4)) for r in df.collect()]}))
    check(pairs[0], 0)
    C.upsert(path)(averages(spark, ("a", 1, 0.25, True)), 0)
    check(pairs[1], 1)
    C.upsert(path)(averages(spark, ("a", 2, 1.0, True)), 1)
    check(pairs[2], 2)
    assert out == {0: [(0, None, None)], 1: [(1, 0.75, 10.0)], 2: [(2, 0.0, 10.0)]}
