"""Camera pairs as streams: pairing, averaging and its upserts, and validation against what is stored."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convoke.operators.folds import table
from convoke.operators.pairing import AVERAGED, PAIRED, Average, validated

SEEN = "time double, r array<array<double>>, t array<double>"
#: PAIRED and the event time that the next operator of the stream goes by.
TIMED = f"{PAIRED}, ts timestamp"


def names(schema: str) -> list[str]:
    return [c.strip().split(" ")[0] for c in schema.split(", ")]


class Pairer(StatefulProcessor):
    """State of a tag between two cameras: the latest sighting by each, dropped by a timer when it is too old to be paired."""

    def __init__(self, tolerance: float):
        self.tolerance = tolerance

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getMapState("seen", "camera string", SEEN)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        seen = {k[0]: tuple(v) for k, v in self.seen.iterator()}
        out, last = [], 0.0
        for m in pd.concat(list(rows)).sort_values("arrival", kind="stable").itertuples(index=False):
            for camera in ("main", "other"):
                if m.sender == getattr(m, camera):
                    seen[camera] = (m.time, [list(x) for x in m.r], list(m.t))
            last = max(last, m.time)
            a, b = seen.get("main"), seen.get("other")
            if a and b and m.time - a[0] <= self.tolerance and m.time - b[0] <= self.tolerance:
                out.append({"pair": key[0], "tag": key[1], "arrival": m.arrival, "time": m.time, "rm": a[1], "tm": a[2], "ra": b[1], "ta": b[2], "ts": m.ts})
        for camera, value in seen.items():
            self.seen.updateValue((camera,), value)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((max(v[0] for v in seen.values()) + self.tolerance) * 1000) + 1 if seen else 1)
        if out:
            yield table(out, names(TIMED))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.seen.clear()
        return iter(())

    def close(self) -> None:
        pass


class Averager(StatefulProcessor):
    """State of a pair of cameras: the transformations that count, one entry each, so that a step writes one or two.

    A pair that isn't seen for ``idle`` seconds is given up by a timer."""

    def __init__(self, top: int, metres: float, degrees: float, idle: float):
        self.bounds, self.idle = (top, metres, degrees), idle

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.steps = handle.getValueState("steps", "n long, first long, next long")
        self.held = handle.getMapState("held", "no long", "row array<double>")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        n, first, after = self.steps.get() if self.steps.exists() else (0, 0, 0)
        average = Average(*self.bounds, [np.array(self.held.getValue((k,))[0]) for k in range(first, after)], n)
        before = list(range(first, after))
        out, last = [], 0.0
        for m in pd.concat(list(rows)).sort_values(["arrival", "tag"], kind="stable").itertuples(index=False):
            size, oldest = len(average.held), average.held[0] if average.held else None
            out += [{"pair": key[0]} | r for r in average.take(m)]
            if size and average.held and average.held[0] is not oldest or size and not average.held:
                first += 1
            last = max(last, m.time)
        after = first + len(average.held)
        for k in before:
            if not first <= k < after:
                self.held.removeKey((k,))
        for k, row in zip(range(first, after), average.held, strict=True):
            if k >= (before[-1] + 1 if before else 0):
                self.held.updateValue((k,), (row.tolist(),))
        self.steps.update((average.steps, first, after))
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        self.handle.registerTimer(int((last + self.idle) * 1000))
        yield table(out, names(AVERAGED))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        self.steps.clear()
        self.held.clear()
        return iter(())

    def close(self) -> None:
        pass


def paired_stream(sightings: DataFrame, tolerance: float, late: str = "1 second") -> DataFrame:
    """The stream form of pairing.paired: one state a tag and pair of cameras, so tags are dealt out. Its event time goes on
    in ts. Sightings of a micro-batch are taken in order of arrival."""
    timed = sightings.withColumn("ts", F.timestamp_seconds("time")).withWatermark("ts", late)
    return timed.groupBy("pair", "tag").transformWithStateInPandas(Pairer(tolerance), TIMED, "append", "EventTime", eventTimeColumnName="ts")


def averaged_stream(pairs: DataFrame, top: int = 5000, metres: float = 0.1, degrees: float = 3.0, idle: float = 600.0) -> DataFrame:
    """The stream form of pairing.averaged over paired_stream's rows (with ts and its watermark)."""
    return pairs.groupBy("pair").transformWithStateInPandas(Averager(top, metres, degrees, idle), AVERAGED, "append", "EventTime")


def version_path(path: str, version: int) -> str:
    return f"{path.rstrip('/')}/version={version:012d}"


def versions(spark: SparkSession, path: str) -> list[int]:
    """Whole versions of a table, ascending: those whose writing ended with its mark."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf())
    if not fs.exists(hadoop):
        return []
    found = [str(s.getPath().getName()) for s in fs.listStatus(hadoop)]
    found = [int(n.split("=")[1]) for n in found if n.startswith("version=")]
    return sorted(v for v in found if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(version_path(path, v), "_SUCCESS")))


def stored(spark: SparkSession, path: str) -> DataFrame:
    """The latest whole version of the transformations (pair, r, t, arrival); empty before the first."""
    found = versions(spark, path)
    if not found:
        return spark.createDataFrame([], "pair string, r array<array<double>>, t array<double>, arrival long")
    return spark.read.parquet(version_path(path, found[-1]))


def upsert(path: str, keep: int = 3):
    """For foreachBatch over averaged rows: the latest kept mean of each pair in place of the one before.

    Each batch that changes something writes a whole new version, named by its batch id, beside the old ones, of which
    ``keep`` stay for readers. A batch that comes again finds its version there and does nothing; one that broke off left no
    mark and is written over. The table has a row for each pair of cameras."""

    def put(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        found = versions(spark, path)
        if found and found[-1] >= batch_id + 1:
            return
        new = batch.where("kept").groupBy("pair").agg(F.max_by(F.struct("r", "t", "arrival"), F.struct("arrival", "tag")).alias("x")).select("pair", "x.r", "x.t", "x.arrival")
        merged = stored(spark, path).join(new.select("pair"), "pair", "left_anti").unionByName(new)
        merged.coalesce(1).write.mode("overwrite").parquet(version_path(path, batch_id + 1))
        for old in found[: len(found) + 1 - keep]:
            hadoop = spark._jvm.org.apache.hadoop.fs.Path(version_path(path, old))
            hadoop.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).delete(hadoop, True)

    return put


def validate(path: str, sink):
    """For foreachBatch over pairings: each micro-batch meets the latest version at its start; sink(rows, batch_id) takes
    the distances."""

    def put(batch: DataFrame, batch_id: int) -> None:
        sink(validated(batch, stored(batch.sparkSession, path)), batch_id)

    return put
