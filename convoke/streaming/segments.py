"""Structured Streaming forms: audio bases' segments with state, windows of sightings, live sections, a sink.

Typed state is kept in RocksDB (streaming.listening.STORE) and given up by a timer when, in the rows' own time, a key isn't
heard of for ``keep`` seconds."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convoke.operators.alignment import ALIGNED, Segments
from convoke.operators.folds import table


class Aligner(StatefulProcessor):
    """State of a session: the latest time of an opened segment, and the messages of those that are open."""

    def __init__(self, bases: int, expiry: float, reach: float, keep: int):
        self.rules, self.keep = (bases, expiry, reach), keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.latest = handle.getValueState("latest", "t double")
        self.open = handle.getListState("open", "segment double, no int, base_id string, arrival long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        segments = Segments(*self.rules)
        if self.latest.exists():
            segments.latest = self.latest.get()[0]
            held: list[tuple[float, list]] = []
            for segment, no, base, arrival in sorted((tuple(x) for x in self.open.get()), key=lambda x: x[1]) if self.open.exists() else ():
                if no == len(held):
                    held.append((segment, []))
                held[no][1].append((base, arrival))
            for segment, messages in held:
                segments.put(segment, messages)
        out, pdf = [], pd.concat(list(rows)).sort_values("arrival", kind="stable")
        for m in pdf.itertuples(index=False):
            out += segments.add(m.base_id, float(m.record_time), int(m.arrival))
        awake(self.handle, pdf["ts"].max(), self.keep)
        self.latest.update((segments.latest,))
        if held := [(s, no, base, arrival) for no, (s, ms) in enumerate(segments.open) for base, arrival in ms]:
            self.open.put(held)
        else:
            self.open.clear()
        if out:
            yield table([{"bucket": key[0], "segment": s, "base_id": b, "arrival": a} for s, ms in out for b, a in ms], ["bucket", "segment", "base_id", "arrival"])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.latest.clear()
        self.open.clear()
        return iter(())

    def close(self) -> None:
        pass


def awake(handle: StatefulProcessorHandle, last: pd.Timestamp, keep: int) -> None:
    """The key's one timer, set anew."""
    for timer in list(handle.listTimers()):
        handle.deleteTimer(timer)
    handle.registerTimer(int(last.timestamp() * 1000) + 1000 * keep)


def aligned_stream(messages: DataFrame, bases: int, expiry: float = 5.0, reach: float = 3.0, keep: int = 3600, late: str = "1 hour") -> DataFrame:
    """The stream form of alignment.aligned: one state for each session, messages of a batch in order of arrival.

    Expiry follows the messages' own times, as in the batch form, not a watermark; what is open when the query stops
    stays in its checkpoint, and goes with a session of which nothing comes for ``keep`` seconds. Messages that are ``late``
    are dropped."""
    rows = messages.select("bucket", "arrival", "base_id", "record_time", F.timestamp_seconds("record_time").alias("ts")).withWatermark("ts", late)
    return rows.groupBy("bucket").transformWithStateInPandas(Aligner(bases, expiry, reach, keep), ALIGNED, "append", "EventTime")


def windows_stream(messages: DataFrame, seconds: int = 1, late: str = "5 seconds") -> DataFrame:
    """The stream form of alignment.windows over messages with a time column ts; later ones than ``late`` are dropped."""
    w = F.window("ts", f"{seconds} seconds")
    g = messages.withWatermark("ts", late).groupBy(w.alias("w"), "bucket", "badge")
    last = g.agg(F.max_by(F.struct("x", "y", "z"), "arrival").alias("p"), F.array_sort(F.collect_list(F.struct("arrival", "targets"))).alias("t"))
    return last.select("bucket", F.unix_timestamp("w.start").alias("window"), "badge", "p.x", "p.y", "p.z", F.flatten(F.col("t.targets")).alias("targets"))


class Changes(StatefulProcessor):
    """State of a section: the key that was last sent."""

    def __init__(self, key: str, kind: str, order: str, time: str, keep: int):
        self.key, self.kind, self.order, self.time, self.keep = key, kind, order, time, keep

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", f"key {self.kind}")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        pdf = pd.concat(list(rows)).sort_values(self.order, kind="stable")
        last, known, sent = self.last.get()[0] if self.last.exists() else None, self.last.exists(), []
        for value in pdf[self.key].tolist():
            value = None if pd.isna(value) else value
            sent.append(not known or value != last)
            last, known = value, True
        self.last.update((last,))
        awake(self.handle, pdf[self.time].max(), self.keep)
        yield pdf[sent]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.last.clear()
        return iter(())

    def close(self) -> None:
        pass


def changed_sections(rows: DataFrame, key: str, order: str = "arrival", time: str = "ts", keep: int = 86_400, late: str = "1 hour") -> DataFrame:
    """A live view's updates: a stream's rows (bucket, section, key, ...) whose key differs from the one last sent for their
    section, so a section that goes back to an earlier key is sent again. Rows of a micro-batch are taken in their order; a
    section of which nothing comes for ``keep`` seconds is sent anew."""
    kind = rows.schema[key].dataType.simpleString()
    return rows.withWatermark(time, late).groupBy("bucket", "section").transformWithStateInPandas(Changes(key, kind, order, time, keep), rows.schema, "append", "EventTime")


def to_sink(rows: DataFrame, path: str, checkpoint: str):
    """Appends each micro-batch to a table of facts, split by session; rerun batches replace nothing twice as the
    checkpoint names those done."""
    return rows.writeStream.format("parquet").partitionBy("bucket").option("path", path).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
