"""Messages of several sources brought together: segments of audio bases, pairs of camera sightings.

The same fold serves batch (sorted rows, one session's state at a time) and stream (state of a session): see streaming.segments."""

from __future__ import annotations

from bisect import bisect_left, insort
from collections import deque

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from convoke.functions import vectors as V
from convoke.operators.folds import folded


class Segments:
    """Open segments of one session and the rules by which messages enter and leave them.

    A message of time r, in order of arrival: the first opens a segment at its whole second. Segments more than
    ``expiry`` before r are emitted. Among open ones within ``reach`` of r that lack this base it joins the earliest;
    if there is none it opens one at r, unless a later one was opened before, when it is dropped. A segment that holds
    ``bases`` results is emitted. What is open in the end is lost unless flushed.

    Segments open at times that never fall, so those that hold the same bases are a list in order of time, in which the
    expired come first and the earliest in reach is found by bisection: a message costs little however many are open."""

    def __init__(self, bases: int, expiry: float = 5.0, reach: float = 3.0):
        self.bases, self.expiry, self.reach = bases, expiry, reach
        self.latest: float | None = None
        self.opened = 0
        self.held: dict[frozenset, list[tuple[float, int, list[tuple]]]] = {}  # by bases: time, number and messages

    @property
    def open(self) -> list[tuple[float, list[tuple]]]:
        """Segment time and its (base, message) in order, in order of opening."""
        return [(s, ms) for s, _, ms in sorted((x for xs in self.held.values() for x in xs), key=lambda x: x[1])]

    def put(self, s: float, messages: list[tuple], no: int | None = None) -> None:
        """Opens a segment with these messages, or takes one back in by its number."""
        if no is None:
            no, self.opened = self.opened, self.opened + 1
        insort(self.held.setdefault(frozenset(b for b, _ in messages), []), (s, no, messages), key=lambda x: x[1])

    def add(self, base: str, r: float, message: object) -> list[tuple[float, list[tuple]]]:
        """Segments that this message completes or expires."""
        if self.latest is None:
            self.latest = float(int(r))
            self.put(self.latest, [(base, message)])
            return []
        late, near, whose = [], None, None
        for bases, xs in list(self.held.items()):
            if r - xs[0][0] > self.expiry:
                gone = bisect_left(xs, True, key=lambda x: r - x[0] <= self.expiry)
                late += xs[:gone]
                del xs[:gone]
                if not xs:
                    del self.held[bases]
                    continue
            if base not in bases:
                at = bisect_left(xs, True, key=lambda x: r - x[0] <= self.reach)
                if at < len(xs) and abs(r - xs[at][0]) <= self.reach and (near is None or xs[at][1] < near[1]):
                    near, whose = xs[at], (bases, at)
        done = [(s, ms) for s, _, ms in sorted(late, key=lambda x: x[1])]
        if near:
            bases, at = whose
            del self.held[bases][at]
            if not self.held[bases]:
                del self.held[bases]
            s, no, ms = near
            ms.append((base, message))
        elif self.latest > r:
            return done
        else:
            self.latest = s = r
            no, ms = None, [(base, message)]
        if len(ms) >= self.bases:
            done.append((s, ms))
        else:
            self.put(s, ms, no)
        return done


ALIGNED = "bucket string, segment double, base_id string, arrival long"


class Alignment:
    """Segments as the state of a fold over a session's messages."""

    def __init__(self, bases: int, expiry: float, reach: float):
        self.segments = Segments(bases, expiry, reach)

    def take(self, m) -> list[dict]:
        return self.rows(self.segments.add(m.base_id, m.record_time, m.arrival))

    def ended(self) -> list[dict]:
        return self.rows(self.segments.open)

    @staticmethod
    def rows(segments: list) -> list[dict]:
        return [{"segment": s, "base_id": b, "arrival": a} for s, ms in segments for b, a in ms]


def aligned(messages: DataFrame, bases: int, expiry: float = 5.0, reach: float = 3.0, flush: bool = False) -> DataFrame:
    """Messages (bucket, arrival, base_id, record_time) with the segment that each ends in; dropped and lost ones go.

    One ordered fold a session: a task holds the open segments of one, never all its messages."""
    rows = messages.select("bucket", "arrival", "base_id", "record_time")
    return folded(rows, ["bucket"], ["arrival"], lambda: Alignment(bases, expiry, reach), ALIGNED, flush)


def in_reach(left: DataFrame, right: DataFrame, time: str, tolerance: float, *keys: str) -> DataFrame:
    """Rows of both (as structs ``a`` and ``b``) with equal keys and times at most the tolerance apart.

    Times fall into bins as wide as the tolerance; a row meets its own bin and both neighbours, an equi-join."""
    bin_of = F.floor(F.col(time) / tolerance).cast("long")
    a = left.select(*(F.col(k).alias(f"_{k}") for k in keys), bin_of.alias("_bin"), F.struct("*").alias("a"))
    b = right.select(*(F.col(k).alias(f"_{k}") for k in keys), F.explode(F.array(bin_of - 1, bin_of, bin_of + 1)).alias("_bin"), F.struct("*").alias("b"))
    near = F.abs(F.col(f"a.{time}") - F.col(f"b.{time}")) <= tolerance
    return a.join(b, [*(f"_{k}" for k in keys), "_bin"]).where(near).select("a", "b")


def nearest_segment(messages: DataFrame, segments: DataFrame, reach: float) -> DataFrame:
    """Messages (bucket, arrival, record_time) with the earliest segment (bucket, record_time) in reach, if any."""
    pairs = in_reach(messages, segments, "record_time", reach, "bucket")
    return pairs.groupBy("a.bucket", "a.arrival").agg(F.min("b.record_time").alias("segment"))


def windows(messages: DataFrame, seconds: int = 1) -> DataFrame:
    """Tumbling windows over messages (bucket, arrival, us, badge, x, y, z, targets): the last place of each badge and
    all its targets, in order of arrival; window is the start in seconds."""
    w = (F.floor(F.col("us") / (seconds * 1_000_000)) * seconds).cast("long")
    g = messages.groupBy("bucket", w.alias("window"), "badge")
    last = g.agg(F.max_by(F.struct("x", "y", "z"), "arrival").alias("p"), F.array_sort(F.collect_list(F.struct("arrival", "targets"))).alias("t"))
    return last.select("bucket", "window", "badge", "p.x", "p.y", "p.z", F.flatten(F.col("t.targets")).alias("targets"))


def unified(sightings: DataFrame, transforms: DataFrame) -> DataFrame:
    """Sightings (sender, p, r) in the main camera's system. A sender without a transformation raises; the table of
    transformations (sender, tr, tt) has a row for each camera, so it is broadcast."""
    j = sightings.join(F.broadcast(transforms.select("sender", "tr", "tt")), "sender", "left")
    have = F.when(F.col("tr").isNull(), F.raise_error(F.concat(F.lit("no transformation for "), "sender"))).otherwise(F.col("tr"))
    return j.withColumns({"p": V.transformed(have, F.col("tt"), F.col("p")), "r": V.product(have, F.col("r"))}).drop("tr", "tt")


def drift_free(pairs: DataFrame, top: int = 5000, metres: float = 0.1, degrees: float = 3.0) -> DataFrame:
    """Running means of a camera pair's transformations without outliers: pair, n, t (mean translation), rejected.

    pairs: pair, arrival, t (3), angle (degrees of the rotation against the first). A value farther than the bounds
    from the mean of the last ``top`` kept ones is taken back, so each step depends on the one before: an ordered fold of
    each pair's rows, with sums of what is held."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        pdf = pdf.sort_values("arrival")
        held: deque = deque()
        total, rejected = np.zeros(4), 0
        for t, a in zip(pdf["t"], pdf["angle"], strict=True):
            row = np.array([*t, a], float)
            if held:
                off = row - total / len(held)
                if np.linalg.norm(off[:3]) > metres or abs(off[3]) > degrees:
                    rejected += 1
                    continue
            held.append(row)
            total += row
            if len(held) > top:
                total -= held.popleft()
        return pd.DataFrame({"pair": [pdf["pair"].iloc[0]], "n": [len(held)], "t": [(total[:3] / len(held)).tolist()], "rejected": [rejected]})

    return pairs.groupBy("pair").applyInPandas(fold, "pair string, n long, t array<double>, rejected long")
