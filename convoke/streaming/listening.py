"""The stream form of operators.listening: each base's voices, open turns and signals as typed state, with a timer."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from convoke.operators.folds import table
from convoke.operators.listening import HEARD, NAMES, Base, Memory, Rules, Voices

#: Typed state is kept in RocksDB; a session that runs these streams must be told so before they start.
STORE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"}


COLUMNS = [c.strip().split(" ")[0] for c in HEARD.split(", ")]


class Held(Memory):
    """Open turns in state: one entry a turn, one a piece of signal, so that a turn that goes on writes its new piece only."""

    def __init__(self, turns, pieces):
        self.turns, self.pieces = turns, pieces
        # start, place in the order of opening, and pieces of each open turn.
        self.open = dict(sorted(((k[0], tuple(v)) for k, v in turns.iterator()), key=lambda x: x[1][1]))

    def names(self) -> list[str]:
        return list(self.open)

    def _put(self, speaker: str, start: float, order: int, n: int, pcm: bytes) -> None:
        self.pieces.updateValue((speaker, n), (pcm,))
        self.open[speaker] = (start, order, n + 1)
        self.turns.updateValue((speaker,), self.open[speaker])

    def opened(self, speaker: str, start: float, pcm: bytes) -> None:
        self._put(speaker, start, 1 + max((o for _, o, _ in self.open.values()), default=0), 0, pcm)

    def extended(self, speaker: str, pcm: bytes) -> None:
        start, order, n = self.open[speaker]
        self._put(speaker, start, order, n, pcm)

    def closed(self, speaker: str) -> tuple[float, bytes]:
        start, _, n = self.open.pop(speaker)
        pcm = b"".join(bytes(self.pieces.getValue((speaker, k))[0]) for k in range(n))
        for k in range(n):
            self.pieces.removeKey((speaker, k))
        self.turns.removeKey((speaker,))
        return start, pcm


class Listener(StatefulProcessor):
    """State of a base: the time of its last segment, its voices, its turns and their pieces."""

    def __init__(self, rules: Rules):
        self.rules = rules

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "t double")
        self.voices = handle.getMapState("voices", "speaker string", "centroid array<double>, n long")
        self.turns = handle.getMapState("turns", "speaker string", "start double, place long, pieces long")
        self.pieces = handle.getMapState("pieces", "speaker string, no long", "pcm binary")

    def _base(self) -> Base:
        known = {k[0]: (list(v[0]), v[1]) for k, v in self.voices.iterator()}
        last = self.last.get()[0] if self.last.exists() else None
        return Base(self.rules, Voices(known), Held(self.turns, self.pieces), last)

    def _keep(self, base: Base) -> None:
        for name in base.voices.changed:
            if name in base.voices.known:
                c, n = base.voices.known[name]
                self.voices.updateValue((name,), (c.tolist(), n))
            else:
                self.voices.removeKey((name,))
        if base.last is None:
            self.last.clear()
        else:
            self.last.update((base.last,))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        base = self._base()
        out = []
        # Rows of one micro-batch come in any order.
        for m in pd.concat(list(rows)).sort_values("arrival", kind="stable").itertuples(index=False):
            out += base.take(m)
        self._keep(base)
        for timer in list(self.handle.listTimers()):
            self.handle.deleteTimer(timer)
        if base.last is not None:
            self.handle.registerTimer(int((base.last + self.rules.idle) * 1000))
        if out:
            yield table([{"bucket": key[0], "base_id": key[1]} | r for r in out], COLUMNS)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        base = self._base()
        out = base.ended()
        self._keep(base)
        if out:
            yield table([{"bucket": key[0], "base_id": key[1]} | r for r in out], COLUMNS)

    def close(self) -> None:
        pass


def heard_stream(messages: DataFrame, rules: Rules, late: str = "10 seconds") -> DataFrame:
    """The stream form of listening.heard: messages (MESSAGES, with record_time set in all) in order of arrival within a
    micro-batch. A session without segments for rules.idle seconds of the messages' own time ends by a timer: its open
    turns come out and its state goes. Set STORE before the query starts."""
    timed = messages.select(*NAMES, F.timestamp_seconds("record_time").alias("ts")).withWatermark("ts", late)
    return timed.groupBy("bucket", "base_id").transformWithStateInPandas(Listener(rules), HEARD, "append", "EventTime")
