"""Who looks at whom, brought up to date after every message: the state of a window is its tags' places and its graph."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convoke.operators.folds import table

#: Rows of a message: one a tag, with its place and outward normal in the main camera's system, and what it was seen to look
#: at. A badge that looks for itself sends its number and targets without a place.
LOOKS = "bucket string, window long, arrival long, tag string, x double, z double, nx double, nz double, targets array<string>"
GRAPH = "bucket string, window long, tag string, targets array<string>"
PLACE = "x double, z double, nx double, nz double"


class Gaze:
    """Places of tags and the graph, in the order in which tags were first seen."""

    def __init__(self, distance: float, cosine: float):
        self.distance, self.cosine = distance, cosine
        self.places: dict[str, tuple[float, float, float, float]] = {}
        self.graph: dict[str, list[str]] = {}
        self.grown: set[str] = set()

    def looks(self, tag: str, target: str) -> bool:
        """Is the target near enough and before the tag's face?"""
        x, z, nx, nz = self.places[tag]
        dx, dz = x - self.places[target][0], z - self.places[target][1]
        far = (dx * dx + dz * dz) ** 0.5
        return 0 < far <= self.distance and (nx * dx + nz * dz) / far < self.cosine

    def add(self, message: list) -> None:
        """A message's rows: its places replace those held, its targets are appended, and then only pairs with a tag that
        moved can look anew, as each other pair was tried when one of them last moved."""
        moved = set()
        for m in message:
            if m.x is not None and m.x == m.x:
                self.places[m.tag] = (m.x, m.z, m.nx, m.nz)
                moved.add(m.tag)
        for m in message:
            if m.targets is not None:
                self.graph.setdefault(m.tag, []).extend(m.targets)
                self.grown.add(m.tag)
        for tag in self.places:
            known = self.graph.setdefault(tag, [])
            if tag in moved:
                self.grown.add(tag)
            for target in self.places if tag in moved else [t for t in self.places if t in moved]:
                if target != tag and target not in known and self.looks(tag, target):
                    known.append(target)
                    self.grown.add(tag)


class Gazing(StatefulProcessor):
    def __init__(self, distance: float, cosine: float, seconds: int):
        self.bounds, self.seconds = (distance, cosine), seconds

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.places = handle.getMapState("places", "tag string", f"{PLACE}, no long")
        self.graph = handle.getMapState("graph", "tag string", "targets array<string>, no long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        gaze = Gaze(*self.bounds)
        gaze.places = {k[0]: tuple(v)[:4] for k, v in sorted(self.places.iterator(), key=lambda x: x[1][4])}
        gaze.graph = {k[0]: list(v[0]) for k, v in sorted(self.graph.iterator(), key=lambda x: x[1][1])}
        pdf = pd.concat(list(rows)).sort_values("arrival", kind="stable")
        seen = set()
        for _, message in pdf.groupby("arrival", sort=True):
            gaze.add(list(message.itertuples(index=False)))
            seen |= set(message["tag"])
        for no, (tag, place) in enumerate(gaze.places.items()):
            if tag in seen:
                self.places.updateValue((tag,), (*place, no))
        for no, (tag, targets) in enumerate(gaze.graph.items()):
            if tag in gaze.grown:
                self.graph.updateValue((tag,), (targets, no))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer((key[1] + 1) * self.seconds * 1000)
        return iter(())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        rows = sorted(self.graph.iterator(), key=lambda x: x[1][1])
        out = [{"bucket": key[0], "window": key[1], "tag": k[0], "targets": list(v[0])} for k, v in rows]
        self.places.clear()
        self.graph.clear()
        if out:
            yield table(out, ["bucket", "window", "tag", "targets"])

    def close(self) -> None:
        pass


def gaze_stream(messages: DataFrame, distance: float = 1.2, cosine: float = -0.7, seconds: int = 1, late: str = "5 seconds") -> DataFrame:
    """Graphs (GRAPH) of windows of so many seconds, out when the watermark passes their end. messages: LOOKS, and a
    time column ts whose window is floor(ts / seconds). A message's rows must come in one micro-batch."""
    timed = messages.withWatermark("ts", late)
    return timed.groupBy("bucket", "window").transformWithStateInPandas(Gazing(distance, cosine, seconds), GRAPH, "append", "EventTime")


def messages_of(sightings: DataFrame, seconds: int = 1) -> DataFrame:
    """Rows of LOOKS with ts from (bucket, time in seconds, arrival, tag, x, z, nx, nz, targets)."""
    ts = F.timestamp_seconds("time")
    return sightings.select("bucket", F.floor(F.col("time") / seconds).alias("window"), "arrival", "tag", "x", "z", "nx", "nz", "targets", ts.alias("ts"))
