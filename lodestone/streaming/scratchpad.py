"""A session's scratch rows as keyed state: they expire a day after the session's last event, or are promoted at its end.

State is a row count, the rows and the time of the last event of each session. A timer stands at that time plus the
time to live; an event that comes later moves it, and when the watermark passes it the rows are let go.
"""

from __future__ import annotations

from datetime import timedelta

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

PROVIDER = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"
OUT = "session_id string, id long, content string, outcome string, at timestamp"


class Scratchpad(StatefulProcessor):
    """Emits promoted rows when their session ends and expired ones when its time is over."""

    def __init__(self, ttl: timedelta, least: float):
        self.ttl, self.least = int(ttl.total_seconds() * 1000), least

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.last = handle.getValueState("last", "at long")
        self.rows = handle.getMapState("rows", "id long", "content string, importance double")

    def handleInputRows(self, key, rows, timerValues):
        session, was = key[0], self.last.get()[0] if self.last.exists() else None
        last, ended = was, None
        for frame in rows:
            for r in frame.itertuples():
                at = int(r.at.timestamp() * 1000)
                last = at if last is None else max(last, at)
                if r.kind == "session.end":
                    ended = at if ended is None else max(ended, at)
                else:
                    self.rows.updateValue((int(r.id),), (r.content, float(r.importance)))
        if was is not None:
            self.handle.deleteTimer(was + self.ttl)
        if ended is not None:
            held = [(k[0], v[0]) for k, v in self.rows.iterator() if v[1] is not None and v[1] >= self.least]
            left = [(k[0], v[0]) for k, v in self.rows.iterator() if v[1] is None or v[1] < self.least]
            self._clear()
            yield from self._told(session, held, "promoted", ended)
            yield from self._told(session, left, "dropped", ended)
            return
        self.last.update((last,))
        self.handle.registerTimer(last + self.ttl)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        held = [(k[0], v[0]) for k, v in self.rows.iterator()]
        self._clear()
        yield from self._told(key[0], held, "expired", expiredTimerInfo.getExpiryTimeInMs())

    def close(self) -> None:
        pass

    def _clear(self) -> None:
        self.rows.clear()
        self.last.clear()

    def _told(self, session, held, outcome, at):
        if held:
            moment = pd.Timestamp(at, unit="ms")
            yield pd.DataFrame({"session_id": session, "id": [k for k, _ in held], "content": [c for _, c in held], "outcome": outcome, "at": moment})


def scratchpad(stream: DataFrame, ttl: timedelta = timedelta(hours=24), late: str = "1 hour", least: float = 0.6) -> DataFrame:
    """What becomes of scratch rows (session_id, id, content, importance, kind, at) of a stream: rows of sessions
    that end are promoted if they are important enough and dropped if not; rows of those that fall silent expire.

    Needs the RocksDB state store, which is set for the session. Events later than the watermark are left out.
    """
    stream.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", PROVIDER)
    timed = stream.withWatermark("at", late)
    return timed.groupBy("session_id").transformWithStateInPandas(Scratchpad(ttl, least), OUT, "append", "EventTime")
