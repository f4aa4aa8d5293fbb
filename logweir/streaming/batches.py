"""Batches of a live stream: a keyed stateful operator whose state is the open batch.

A batch ends with its ``length``-th event, or before the event that is a period or more after its first;
a timer, due a period after the first event's time but no sooner than ``LEAST_WAIT``, ends a batch that
no event ends. A key's open batch, its events and when it is due, is state of the engine: it is written
with the micro-batch that made it, and lies where the key's tasks run.
"""

from __future__ import annotations

from collections.abc import Iterator
from datetime import timedelta

from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor

from logweir.schema import EVENT

#: Milliseconds that a batch whose time is over already still waits for more.
LEAST_WAIT = 100
_EVENT = "id long, type int, foreign_id string, at long, metadata binary, trace binary"
_NAMES = [c.split()[0] for c in _EVENT.split(", ")]
_OUT = f"part long, batch long, held long, {_EVENT}"
_row = Row("part", "batch", "held", *_NAMES)


class OpenBatch(StatefulProcessor):
    """The rule above for one key. ``length`` 0 and ``period`` (microseconds) 0 set no bound."""

    def __init__(self, length: int, period: int):
        self.length, self.period = length, period

    def init(self, handle) -> None:
        self.handle = handle
        #: First id, its time in microseconds, and when the timer is due in milliseconds; 0 without one.
        self.mark = handle.getValueState("mark", "first long, start long, due long")
        self.events = handle.getListState("events", _EVENT)

    def _closed(self, part: int, first: int, events: list[tuple]) -> Iterator[Row]:
        for e in events:
            yield _row(part, first, None, *e)

    def handleInputRows(self, key, rows, timerValues) -> Iterator[Row]:  # noqa: N802, N803
        part, mark = key[0], self.mark.get()
        events = [tuple(e) for e in self.events.get()] if mark is not None else []
        first, start, due = tuple(mark) if mark is not None else (None, None, 0)
        before = due
        for e in sorted((tuple(r[c] for c in _NAMES) for r in rows), key=lambda e: e[0]):
            if events and self.period and e[3] >= start + self.period:
                yield from self._closed(part, first, events)
                events = []
            if not events:
                first, start = e[0], e[3]
                wait = timerValues.getCurrentProcessingTimeInMs() + LEAST_WAIT
                due = max(wait, (start + self.period) // 1000) if self.period else 0
            events.append(e)
            if self.length and len(events) == self.length:
                yield from self._closed(part, first, events)
                events = []
        if before and before != (due if events else 0):
            self.handle.deleteTimer(before)
        if events:
            self.mark.update((first, start, due))
            self.events.put(events)
            if due and due != before:
                self.handle.registerTimer(due)
        else:
            self.mark.clear()
            self.events.clear()
        yield _row(part, None, len(events), *[None] * len(_NAMES))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        mark = self.mark.get()
        if mark is None or not mark[2] or mark[2] > expiredTimerInfo.getExpiryTimeInMs():
            return
        yield from self._closed(key[0], mark[0], [tuple(e) for e in self.events.get()])
        self.mark.clear()
        self.events.clear()
        yield _row(key[0], None, 0, *[None] * len(_NAMES))

    def close(self) -> None:
        pass


def closed(stream: DataFrame, *, length: int = 0, period: timedelta = timedelta(0), part: Column | None = None) -> DataFrame:
    """The events of closed batches of a stream of events, with ``part``, the batch's key, and ``batch``,
    its first id; and for each key that changed a row without an id, how many events it holds."""
    key = (F.lit(0) if part is None else part).cast("long")
    rows = stream.select(key.alias("part"), "id", "type", "foreign_id", F.unix_micros("timestamp").alias("at"), "metadata", "trace")
    out = rows.groupBy("part").transformWithState(OpenBatch(length, period // timedelta(microseconds=1)), _OUT, "append", "processingTime")
    return out.select("part", "batch", "held", *[F.timestamp_micros("at").alias("timestamp") if f.name == "timestamp" else F.col(f.name) for f in EVENT])
