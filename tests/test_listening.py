"""Recognition and turns of bases: hand-computed borders, the walk over a shrinking list, streams against batches."""

import copy
import random
from collections import namedtuple
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from convoke.functions import gates
from convoke.operators import listening as L
from convoke.streaming import listening as S

A, B = np.array([1.0, 0.0]), np.array([0.0, 1.0])


def hear(pcm):
    """The voice of a test signal: the letter that it has most of; dots are silence."""
    a, b = pcm.count(b"a"), pcm.count(b"b")
    return None if not a + b else A if a >= b else B


RULES = L.Rules(hear, weigh=False, seconds=4.0, rate=1, rms=0.1, peak=0.1)


def turns(rules, *segments):
    """Chunks of segments (speaker, signal), four seconds each, the open one last."""
    voices = L.Voices({"A": (A, 1), "B": (B, 1)})
    memory, out = L.Memory(), []
    for i, (speaker, pcm) in enumerate(segments):
        out += L.one_turn(memory, voices, rules, speaker, 4.0 * i, pcm)
    return out + [(name, *memory.closed(name)) for name in memory.names()]


@pytest.mark.parametrize(
    "left,right,first,second",
    [
        (b"aa", b"bb", ("A", 0.0, 4.0, b"aaaa"), ("B", 4.0, b"bbbb")),  # both halves as before and after
        (b"aa", b"aa", ("A", 0.0, 6.0, b"aaaaaa"), ("B", 6.0, b"bb")),  # the old turn goes on for a half
        (b"bb", b"bb", ("A", 0.0, 2.0, b"aa"), ("B", 2.0, b"bbbbbb")),  # the new one began a half before
        (b"..", b"bb", ("A", 0.0, 2.0, b"aa"), ("B", 4.0, b"bbbb")),  # silence before
        (b"aa", b"..", ("A", 0.0, 4.0, b"aaaa"), ("B", 6.0, b"bb")),  # silence after
        (b"..", b"..", ("A", 0.0, 2.0, b"aa"), ("B", 6.0, b"bb")),  # on both sides
        (b"bb", b"aa", ("A", 0.0, 2.0, b"aa"), ("B", 6.0, b"bb")),  # the wrong way round
    ],
)
def test_borders(left, right, first, second):
    assert turns(RULES, ("A", b"aa" + left), ("B", right + b"bb")) == [first, second]


def test_chunks_without_results(spark):
    rows = [("s", "b", -2, "register", 0.0, "A", None, None, [1.0, 0.0], None, None), ("s", "b", -1, "register", 0.0, "B", None, None, [0.0, 1.0], None, None)]
    rows += [("s", "b", i, "segment", 4.0 * i, None, 1.0, 1.0, [1.0, 0.0] if i % 5 < 3 else [0.0, 1.0], b"aaaa" if i % 5 < 3 else b"bbbb", None) for i in range(60)]
    df = spark.createDataFrame(rows, L.MESSAGES)
    alone = L.heard(df, RULES, flush=True, results=False).collect()
    assert sorted(map(str, alone)) == sorted(map(str, L.heard(df, RULES, flush=True).where("kind = 'chunk'").collect())) and len(alone) == 24


def test_sentinels_at_borders():
    # Between silence and noise nobody is to be recognised: each half keeps its own side unless it holds no speech.
    assert turns(RULES, ("silent", b"...."), ("unknown", b"aaaa")) == [("silent", 0.0, 4.0, b"...."), ("unknown", 4.0, b"aaaa")]
    # A real name beside a sentinel is taken on for a likeness above the bound, and the turn grows back.
    assert turns(RULES, ("unknown", b"..bb"), ("B", b"bbbb")) == [("unknown", 0.0, 2.0, b".."), ("B", 2.0, b"bbbbbb")]
    # A turn whose whole signal goes to the next has no chunk.
    assert turns(RULES, ("A", b"bb"), ("B", b"bbbb")) == [("B", 2.0, b"bbbbbb")]
    with pytest.raises(ValueError):
        turns(RULES, ("A", b"aaaa"), ("C", b"bbbb"))


def test_several_turns():
    memory = L.Memory()
    walk = lambda t, **signals: L.several_turns(memory, signals, t)
    assert walk(0.0, A=b"a0", B=b"b0", C=b"c0") == []
    # A and B stop at once: the walk passes over B, which stays open, and C goes on.
    assert walk(3.0, C=b"c1") == [("A", 0.0, 3.0, b"a0")]
    assert memory.names() == ["B", "C"]
    # B ends now; C, right after it, is passed over and loses this signal. D opens.
    assert walk(6.0, C=b"c2", D=b"d2") == [("B", 0.0, 6.0, b"b0")]
    assert walk(9.0, C=b"c3", D=b"d3") == []
    assert [(n, *memory.closed(n)) for n in memory.names()] == [("C", 0.0, b"c0c1c3"), ("D", 6.0, b"d2d3")]
    memory = L.Memory()
    assert L.several_turns(memory, {"A": b"a", "B": b"b", "C": b"c"}, 0.0, skips=False) == []
    assert L.several_turns(memory, {"C": b"c"}, 3.0, skips=False) == [("A", 0.0, 3.0, b"a"), ("B", 0.0, 3.0, b"b")]


def test_several_turns_against_a_list():
    """The same walk over Python's own list."""
    rng = random.Random(6)
    for _ in range(400):
        memory, held, open_ = L.Memory(), {}, []
        for t in range(12):
            now = rng.sample("ABCD", rng.randrange(1, 4))
            signals = {s: f"{s}{t}".encode() for s in now}
            want = []
            if open_:
                for s in open_:
                    if s in signals:
                        held[s] = held[s][0], held[s][1] + signals[s]
                    else:
                        start, pcm = held.pop(s)
                        open_.remove(s)
                        want.append((s, start, t, pcm))
            for s in now:
                if s not in open_:
                    open_.append(s)
                    held[s] = t, signals[s]
            assert L.several_turns(memory, signals, t) == want and memory.names() == open_


def test_reconciled_as_the_column(spark):
    rng = random.Random(2)
    every = []
    for i in range(300):
        n = rng.randrange(1, 3)
        every.append((i, [(rng.choice(["silent", "unknown", "A", "B"]), rng.choice([0.1, 0.5, 0.7]), rng.choice([1.0, 2.0])) for _ in range(n)]))
    df = spark.createDataFrame(every, "i int, s array<struct<speaker: string, similarity: double, duration: double>>")
    for row in df.select("s", gates.reconciled(F.col("s")).alias("r")).collect():
        entries = [x.asDict() for x in row.s]
        assert L.reconciled(copy.deepcopy(entries)) == [x.asDict() for x in row.r]


Message = namedtuple("Message", "kind arrival record_time speaker rms peak v pcm signals")


def segment(t, v, pcm=b"aaaa", rms=0.5, peak=0.9, signals=()):
    return Message("segment", int(t), t, None, rms, peak, v, pcm, [{"pcm": p, "v": w} for p, w in signals])


def voice(name, v):
    return Message("register", -1, 0.0, name, None, None, v, None, None)


def test_recognised_in_order():
    rules = L.Rules(hear, threshold=0.4, update=0.6, rms=0.25, peak=0.5, seconds=4.0, rate=1)
    base = L.Base(rules)
    for m in (voice("A", [2.0, 0.0]), voice("B", [0.0, 3.0])):
        assert base.take(m) == []
    one = base.take(segment(4.0, [0.8, 0.6]))[0]
    # 0.8 x ln 0.5 / ln 0.25, and the voice has moved to the mean of both vectors.
    assert (one["speakers"], one["similarities"], one["durations"]) == (["A"], [0.4], [2.0])
    assert np.allclose(base.voices.known["A"][0], [0.9, 0.3]) and base.voices.known["A"][1] == 2
    # The next is compared with what the first has changed: 0.9 x 0.6 + 0.3 x 0.8 = 0.78 against B's 0.8.
    assert base.take(segment(8.0, [0.6, 0.8]))[0]["speakers"] == ["B"]
    assert base.take(segment(12.0, [1.0, 0.0], rms=0.2))[0]["speakers"] == ["silent"]
    assert base.take(segment(16.0, None))[0]["similarities"] == [0.0]
    # Unlike all voices it stays unknown with its own similarity; without any, the peak over its bound stands for one.
    assert base.take(segment(20.0, [-1.0, 0.1]))[0]["speakers"] == ["unknown"]
    base.take(Message("reset", 0, 20.0, *[None] * 6))
    assert base.take(segment(24.0, [1.0, 0.0]))[0]["similarities"] == [round(0.4 * 0.9 / 0.5, 4)]


def test_separated():
    base = L.Base(L.Rules(hear, mode="best", weigh=False, rms=0.1, peak=0.1, seconds=4.0, rate=1))
    base.take(voice("A", A)), base.take(voice("B", B))
    r = base.take(segment(0.0, A, b"0123", signals=[(b"", None), (b"aa", [0.8, 0.6]), (b"bbb", [0.1, 2.0])]))[0]
    assert (r["speakers"], r["durations"]) == (["B"], [1.5]) and base.memory.turns["B"].pieces == [b"bbb"]
    assert base.take(segment(4.0, A, b"0123", rms=0.05))[0]["speakers"] == ["silent"]
    every = L.Base(L.Rules(hear, mode="all", weigh=False, rms=0.1, peak=0.1, seconds=4.0, rate=1))
    every.take(voice("A", A)), every.take(voice("B", B))
    assert every.take(segment(0.0, A, signals=[(b"a", A), (b"b", B)]))[0]["speakers"] == ["A", "B"]
    assert every.take(segment(4.0, A, signals=[(b"c", None), (b"d", B)]))[0]["speakers"] == ["B"]
    assert every.take(segment(8.0, None))[0]["speakers"] == ["silent"]


def sessions(rng, mode):
    """Messages of six bases, one with a break that ends its session."""
    rows = []
    for k in range(6):
        key, n, t = (f"s{k // 2}", f"b{k % 2}"), 0, 100.0
        for name, v in (("A", A), ("B", B)):
            rows.append((*key, n, "register", t, name, None, None, v.tolist(), None, None))
            n += 1
        for i in range(25):
            t += 4.0
            if k == 1 and i == 12:
                t += 50.0
                rows.append((*key, n, "register", t, "A", None, None, A.tolist(), None, None))
                rows.append((*key, n + 1, "register", t, "B", None, None, B.tolist(), None, None))
                n += 2
            pcm = "".join(rng.choices("ab.", k=2)) * 2
            v = rng.choice([None, [rng.random(), rng.random()], A.tolist(), B.tolist()])
            signals = [(x.encode(), w) for x, w in ((rng.choice(["aa", "bb", "b"]), rng.choice([None, A.tolist(), [0.3, rng.random() + 0.1]])) for _ in range(2))]
            rows.append((*key, n, "segment", t, None, rng.choice([0.05, 0.5]), 0.9, v, pcm.encode(), signals))
            n += 1
    return rows


def plain(rows):
    return sorted(repr(tuple(r.asDict().values())) for r in rows)


@pytest.mark.parametrize("mode", ["one", "best", "all"])
def test_stream_as_batch(spark, tmp_path, mode):
    rng = random.Random(len(mode))
    rows = sessions(rng, mode)
    rules = L.Rules(hear, mode=mode, weigh=False, rms=0.1, peak=0.1, seconds=4.0, rate=1, idle=30.0)
    batch = L.heard(spark.createDataFrame(rows, L.MESSAGES).repartition(3), rules, flush=True)
    want = plain(batch.collect())
    assert len(want) > 150
    for k, v in S.STORE.items():
        spark.conf.set(k, v)
    # Files of some rows each, in order of time but shuffled within; then one that ends every session.
    rows.sort(key=lambda r: (r[4], r[2]))
    files = [rows[i : i + 40] for i in range(0, len(rows), 40)]
    far = [("end", "end", 0, "segment", 10_000.0, None, 0.0, 0.0, None, b"", [])]
    files += [far, [(*far[0][:2], 1, "segment", 20_000.0, *far[0][5:])]]
    source, seen = tmp_path / "in", []

    def write(no, part):
        rng.shuffle(part)
        spark.createDataFrame(part, L.MESSAGES).coalesce(1).write.mode("append").parquet(str(source / f"f{no:03}"))

    def run():
        stream = spark.readStream.schema(L.MESSAGES).option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(source))
        query = (
            S.heard_stream(stream, rules).writeStream.foreachBatch(lambda df, _: seen.extend(df.collect()))
            .option("checkpointLocation", str(tmp_path / "state")).trigger(availableNow=True).start()
        )
        query.awaitTermination()
        return query.lastProgress

    # The query stops and starts again in the middle of all sessions.
    for no, part in enumerate(files[:2]):
        write(no, part)
    run()
    for no, part in enumerate(files[2:]):
        write(no + 2, part)
    progress = run()
    got = plain(r for r in seen if r.bucket != "end")
    assert got == want
    # What is left in state are two values: the time of the one session that is still open, and its turn with its piece.
    assert progress["stateOperators"][0]["numRowsTotal"] < 12
    assert Path(tmp_path / "state").exists()
