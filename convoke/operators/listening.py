"""What a base hears: segments recognised in order, the voices that it knows, and the turns it puts together.

Signals are cut, cleaned and embedded beforehand, in parallel (a segment comes with rms, peak and v, null where nobody
speaks). What depends on the segments before it is an ordered fold of each base's own rows: its library, which every
sure match changes, and the turns that are open. The same fold serves batch (rows sorted within partitions, one
state held at a time) and stream (typed state: see streaming.listening).
"""

from __future__ import annotations

import math
from collections.abc import Callable
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from convoke.operators.folds import folded

SENTINELS = ("silent", "unknown")

#: Messages of a base. kind: segment, register (v of a voice, speaker its name) or reset (forget all voices). pcm: 16-bit
#: samples; signals: what separation made of them, each with its own v.
MESSAGES = "bucket string, base_id string, arrival long, kind string, record_time double, speaker string, rms double, peak double, v array<double>, pcm binary, signals array<struct<pcm: binary, v: array<double>>>"
NAMES = ["bucket", "base_id", "arrival", "kind", "record_time", "speaker", "rms", "peak", "v", "pcm", "signals"]

#: What comes of them. kind: result (a segment's speakers) or chunk (a turn's signal).
HEARD = "bucket string, base_id string, kind string, arrival long, record_time double, speakers array<string>, similarities array<double>, durations array<double>, chunk_end double, pcm binary"


@dataclass(frozen=True)
class Rules:
    """How a base listens.

    mode: ``one`` recognises the segment; ``best`` recognises its separated signals and keeps the surest; ``all`` keeps
    them all, reconciled, and lets several turns be open. ``weigh`` makes similarities of quiet speech smaller. hear gives
    the v of a signal (null: no speech) for the halves at a border. idle: so many seconds without a segment end a session."""

    hear: Callable[[bytes], np.ndarray | None]
    mode: str = "one"
    threshold: float = 0.4
    keep: float = 0.1
    update: float = 0.6
    rms: float = 0.0
    peak: float = 0.0
    weigh: bool = True
    seconds: float = 3.0
    rate: int = 16_000
    idle: float = 600.0

    def duration(self, pcm: bytes) -> float:
        return len(pcm) / 2 / self.rate


def unit(v: np.ndarray) -> np.ndarray:
    v = np.asarray(v, float)
    return v / math.sqrt(v @ v)


class Voices:
    """Named centroids with the number of vectors in each, in order of their names."""

    def __init__(self, known: dict[str, tuple[np.ndarray, int]] | None = None):
        self.known = {name: (np.asarray(c, float), n) for name, (c, n) in sorted((known or {}).items())}
        self.changed: set[str] = set()

    def register(self, name: str, v: np.ndarray) -> None:
        """One more vector of a voice, as a unit."""
        u = unit(v)
        c, n = self.known.get(name, (np.zeros(len(u)), 0))
        if name not in self.known:
            self.known = dict(sorted([*self.known.items(), (name, (c, n))]))
        self.known[name] = ((c * n + u) / (n + 1), n + 1)
        self.changed.add(name)

    def recognised(self, v: np.ndarray, update: float) -> tuple[str, float]:
        """The voice with the largest product and that product; above ``update`` it takes the vector in. Of equals the
        first name; without any voice ``unknown``, 0."""
        if not self.known:
            return "unknown", 0.0
        u = unit(v)
        scores = [float(c @ u) for c, _ in self.known.values()]
        at = scores.index(max(scores))
        name = list(self.known)[at]
        if scores[at] > update:
            self.register(name, u)
        return name, scores[at]

    def among(self, v: np.ndarray, candidates: list[str], origin: str, keep: float) -> str:
        """The best of these; a sentinel as origin stays unless the similarity is above ``keep``. A name that isn't
        registered raises."""
        real = [c for c in candidates if c not in SENTINELS]
        if not real:
            return origin
        u = unit(v)
        if lost := [c for c in real if c not in self.known]:
            raise ValueError(f"not registered: {', '.join(lost)}")
        scores = [float(self.known[c][0] @ u) for c in real]
        at = scores.index(max(scores))
        return real[at] if origin not in SENTINELS or scores[at] > keep else origin


def reconciled(entries: list[dict]) -> list[dict]:
    """gates.reconciled for one segment: entries of speaker, similarity, duration and pcm."""
    if len(entries) < 2:
        return entries
    a, b = entries[:2]
    real = [e for e in (a, b) if e["speaker"] not in SENTINELS]
    if len(real) == 2:
        return [a, b] if a["speaker"] != b["speaker"] else [a if a["similarity"] > b["similarity"] else b]
    if real:
        return real
    if a["speaker"] != b["speaker"]:
        return [a if a["speaker"] == "unknown" else b]
    return [a] if a["speaker"] == "silent" or a["duration"] >= b["duration"] else [b]


@dataclass
class Turn:
    """An open turn: since when, and its signal in pieces."""

    speaker: str
    start: float
    pieces: list[bytes] = field(default_factory=list)


class Memory:
    """The turns that are open, in order of opening, in memory. The stream's form keeps the pieces in state."""

    def __init__(self) -> None:
        self.turns: dict[str, Turn] = {}

    def names(self) -> list[str]:
        return list(self.turns)

    def opened(self, speaker: str, start: float, pcm: bytes) -> None:
        self.turns[speaker] = Turn(speaker, start, [pcm])

    def extended(self, speaker: str, pcm: bytes) -> None:
        self.turns[speaker].pieces.append(pcm)

    def closed(self, speaker: str) -> tuple[float, bytes]:
        turn = self.turns.pop(speaker)
        return turn.start, b"".join(turn.pieces)


Chunk = tuple[str, float, float, bytes]


def one_turn(memory: Memory, voices: Voices, rules: Rules, speaker: str, t: float, pcm: bytes) -> list[Chunk]:
    """A segment of one speaker: the turn goes on, or ends where the halves on both sides of the border say.

    Half a segment before the border and the segment's first half are recognised among the two speakers (``silent`` where
    nobody speaks). Both as before: the old turn takes the first half. Both as after: the new one takes half a segment
    back. Else each half that isn't its own side's is lost. An old turn without signal ends without a chunk."""
    names = memory.names()
    if not names:
        memory.opened(speaker, t, pcm)
        return []
    before = names[0]
    if before == speaker:
        memory.extended(speaker, pcm)
        return []
    start, old = memory.closed(before)
    end, half, shift = t, len(pcm) // 2, rules.seconds / 2
    if old:
        # A half of no bytes takes the whole: old[-0:] is old, old[:-0] nothing.
        left, right = (side(rules, voices, x, [before, speaker], origin) for x, origin in ((old[-half:], before), (pcm[:half], speaker)))
        if left == right == before:
            old, pcm, t = old + pcm[:half], pcm[half:], t + shift
            end = t
        elif left == right == speaker:
            old, pcm, t = old[:-half], old[-half:] + pcm, t - shift
            end = t
        else:
            if left != before:
                old, end = old[:-half], t - shift
            if right != speaker:
                pcm, t = pcm[half:], t + shift
    memory.opened(speaker, t, pcm)
    return [(before, start, end, old)] if old else []


def side(rules: Rules, voices: Voices, pcm: bytes, candidates: list[str], origin: str) -> str:
    v = rules.hear(pcm)
    return "silent" if v is None else voices.among(v, candidates, origin, rules.keep)


def several_turns(memory: Memory, signals: dict[str, bytes], t: float, skips: bool = True) -> list[Chunk]:
    """A segment of several speakers (each with its signal): turns of those who go on grow, those of others end, new ones open.

    With ``skips`` the open turns are walked as a list that shrinks under the walk: the one after a turn that ends is
    passed over this time. If it has ended it ends a segment later or more; if it goes on its signal of this segment is
    lost. Without, each turn is looked at."""
    done, passed = [], False
    for speaker in memory.names():
        if passed:
            passed = False
        elif speaker in signals:
            memory.extended(speaker, signals[speaker])
        else:
            start, pcm = memory.closed(speaker)
            done.append((speaker, start, t, pcm))
            passed = skips
    there = set(memory.names())
    for speaker, pcm in signals.items():
        if speaker not in there:
            memory.opened(speaker, t, pcm)
    return done


class Base:
    """The fold of one base: its voices, its open turns, and the time of its last segment."""

    def __init__(self, rules: Rules, voices: Voices | None = None, memory: Memory | None = None, last: float | None = None):
        self.rules, self.voices, self.memory, self.last = rules, voices or Voices(), memory or Memory(), last

    def take(self, m) -> list[dict]:
        """What a message gives: its result and the chunks that it closes."""
        if m.kind == "reset":
            self.voices.changed |= set(self.voices.known)
            self.voices.known = {}
            return []
        if m.kind == "register":
            self.voices.register(m.speaker, m.v)
            return []
        out = []
        if self.last is not None and m.record_time - self.last > self.rules.idle:
            out = self.ended()
        self.last = m.record_time
        entries = {"one": self.one, "best": self.best, "all": self.all}[self.rules.mode](m)
        if self.rules.mode == "all":
            closed = several_turns(self.memory, {e["speaker"]: e["pcm"] for e in entries}, m.record_time)
        else:
            closed = one_turn(self.memory, self.voices, self.rules, entries[0]["speaker"], m.record_time, entries[0]["pcm"])
        result = {
            "kind": "result", "arrival": m.arrival, "record_time": m.record_time, "speakers": [e["speaker"] for e in entries],
            "similarities": [round(e["similarity"], 4) for e in entries], "durations": [e["duration"] for e in entries],
        }
        return [*out, result, *map(self.chunk, closed)]

    def ended(self) -> list[dict]:
        """The end of a session: open turns close a segment after its last one began, and all is forgotten."""
        end = (self.last or 0.0) + self.rules.seconds
        closed = [(name, *self.memory.closed(name)) for name in self.memory.names()]
        self.voices.changed |= set(self.voices.known)
        self.voices.known, self.last = {}, None
        return [self.chunk((name, start, end, pcm)) for name, start, pcm in closed if pcm]

    @staticmethod
    def chunk(c: Chunk) -> dict:
        return {"kind": "chunk", "record_time": c[1], "speakers": [c[0]], "chunk_end": c[2], "pcm": c[3]}

    def loud(self, m) -> bool:
        return m.rms > self.rules.rms and m.peak > self.rules.peak

    def weighted(self, similarity: float, m) -> float:
        r = self.rules
        return min(similarity * math.log(m.rms) / math.log(r.rms), 1.0) if r.weigh else similarity

    def one(self, m) -> list[dict]:
        r, speaker, similarity, duration = self.rules, "silent", 0.0, self.rules.seconds
        if m.v is not None and self.loud(m):
            name, similarity = self.voices.recognised(m.v, r.update)
            speaker, duration = "unknown", r.duration(m.pcm)
            if similarity > r.threshold:
                speaker, similarity = name, self.weighted(similarity, m)
            elif similarity == 0 and r.weigh:
                similarity = r.threshold * m.peak / r.peak
        return [{"speaker": speaker, "similarity": similarity, "duration": duration, "pcm": m.pcm}]

    def best(self, m) -> list[dict]:
        r = self.rules
        found = {"speaker": "unknown" if m.v is not None else "silent", "similarity": 0.0, "duration": r.seconds, "pcm": m.pcm}
        if m.v is not None and self.loud(m):
            for s in m.signals:
                if s["v"] is not None:
                    name, similarity = self.voices.recognised(s["v"], r.update)
                    if similarity > found["similarity"]:
                        found |= {"similarity": similarity, "duration": r.duration(s["pcm"]), "pcm": s["pcm"] or m.pcm}
                        if similarity > r.threshold:
                            found["speaker"] = name
            if found["similarity"] > r.threshold:
                found["similarity"] = self.weighted(found["similarity"], m)
        if found["speaker"] == "unknown" and found["similarity"] == 0:
            found["speaker"] = "silent"
        return [found]

    def all(self, m) -> list[dict]:
        r = self.rules
        if m.v is None or not self.loud(m):
            return [{"speaker": "silent", "similarity": 0.0, "duration": r.seconds, "pcm": b""}]
        entries = []
        for s in m.signals:
            e = {"speaker": "silent", "similarity": 0.0, "duration": r.seconds, "pcm": s["pcm"]}
            if s["v"] is not None:
                name, similarity = self.voices.recognised(s["v"], r.update)
                e |= {"speaker": name if similarity > r.threshold else "unknown", "similarity": similarity, "duration": r.duration(s["pcm"])}
            entries.append(e)
        return reconciled(entries) or [{"speaker": "silent", "similarity": 0.0, "duration": r.seconds, "pcm": b""}]


class Turns(Base):
    """The fold of a base of which only the chunks are wanted."""

    def take(self, m) -> list[dict]:
        return [x for x in super().take(m) if x["kind"] == "chunk"]


def heard(messages: DataFrame, rules: Rules, flush: bool = False, results: bool = True) -> DataFrame:
    """Results (if wanted) and chunks (HEARD) of messages (MESSAGES), in order of arrival for each base of each session.

    What is open in the end is lost unless flushed. A base's messages are one ordered fold; rows pass through it
    sorted, so that a task holds one base's state at a time."""

    return folded(messages.select(NAMES), ["bucket", "base_id"], ["arrival"], lambda: (Base if results else Turns)(rules), HEARD, flush)


def results(heard: DataFrame) -> DataFrame:
    return heard.where("kind = 'result'").select("bucket", "base_id", "arrival", "record_time", "speakers", "similarities", "durations")


def chunks(heard: DataFrame, spoken: bool = True) -> DataFrame:
    """Closed turns: bucket, base_id, speaker, chunk_start, chunk_end, pcm; only those of real speakers if spoken."""
    c = heard.where("kind = 'chunk'").select("bucket", "base_id", F.col("speakers")[0].alias("speaker"), F.col("record_time").alias("chunk_start"), "chunk_end", "pcm")
    return c.where(~F.col("speaker").isin(*SENTINELS)) if spoken else c
