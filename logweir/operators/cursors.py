"""Cursor stores as sets of rows: sets to a cursor are folded, not looped over."""

from __future__ import annotations

import json
import threading
from collections.abc import Callable
from datetime import datetime, timezone
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.errors import CursorNotIncreasing, InvalidId
from logweir.schema import CursorColumns
from logweir.storage import Versions

#: Seconds after which a waiting set is flushed.
FLUSH_PERIOD = 5.0


def typed(cursor: Column, strings: bool) -> Column:
    """Cursors compare as integers, or as text where the store holds strings."""
    return cursor.cast("string") if strings else cursor.cast("bigint")


def monotone(sets: DataFrame, *, strings: bool = False) -> DataFrame:
    """Sets (consumer, seq, cursor) in order of seq; ``accepted`` where a cursor exceeds all before it.

    A refused set is below an accepted one, so the running maximum over all sets is that over the
    accepted ones."""
    before = Window.partitionBy("consumer").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    value = typed(F.col("cursor"), strings)
    return sets.withColumn("accepted", F.coalesce(value > F.max(value).over(before), F.lit(True)))


def final(sets: DataFrame, *, strings: bool = False) -> DataFrame:
    """The stored cursor of each consumer after all sets."""
    return sets.groupBy("consumer").agg(F.max(typed(F.col("cursor"), strings)).cast("string").alias("cursor"))


def flushed(sets: DataFrame, window: Column, *, strings: bool = False) -> DataFrame:
    """Write-behind: the last set of each consumer in a flush window is what the flush writes."""
    last = sets.withColumn("flush", window).groupBy("consumer", "flush").agg(F.max_by("cursor", "seq").alias("cursor"))
    return monotone(last.withColumnRenamed("flush", "seq"), strings=strings).withColumnRenamed("seq", "flush")


def overwritten(sets: DataFrame) -> DataFrame:
    """A store without order, as in memory: the last set counts."""
    return sets.groupBy("consumer").agg(F.max_by("cursor", "seq").alias("cursor"))


def read_through(primary: DataFrame, fallback: DataFrame) -> DataFrame:
    """(consumer, cursor, copied): the primary's cursor, else the fallback's, which is then copied."""
    p = primary.select("consumer", F.nullif(F.col("cursor"), F.lit("")).alias("p"))
    f = fallback.select("consumer", F.nullif(F.col("cursor"), F.lit("")).alias("f"))
    both = p.join(f, "consumer", "full")
    return both.select("consumer", F.coalesce("p", "f", F.lit("")).alias("cursor"), (F.col("p").isNull() & F.col("f").isNotNull()).alias("copied"))


class MemoryCursors:
    """A store in memory, which may go back."""

    def __init__(self, **cursors: str | int):
        self.cursors = {k: str(v) for k, v in cursors.items()}

    def get(self, consumer: str) -> str:
        return self.cursors.get(consumer, "")

    def set(self, consumer: str, cursor: str) -> None:
        self.cursors[consumer] = cursor

    def flush(self) -> None:
        pass


class BufferedCursors:
    """A store that only goes forward; unless ``buffered`` is off, sets wait for a flush.

    ``rank`` is what cursors compare by where neither integers nor text will do: for those of blobs,
    ``functions.blobs.rank_of``. With a ``period`` in seconds, a set that still waits after it is flushed in the background. A
    failure there is raised by the next set or flush. ``on_set`` is told of each stored cursor."""

    def __init__(self, *, strings: bool = False, buffered: bool = True, period: float | None = None, on_set=None, rank: Callable[[str], Any] | None = None):
        self.strings, self.buffered, self.period, self.on_set, self.rank = strings, buffered, period, on_set, rank
        self.stored: dict[str, str] = {}
        self.waiting: dict[str, str] = {}
        self._lock, self._timer, self._failure = threading.RLock(), None, None

    def _key(self, cursor: str):
        if self.rank:
            return self.rank(cursor)
        if self.strings:
            return cursor
        try:
            return int(cursor)
        except ValueError as e:
            raise InvalidId(cursor) from e

    def get(self, consumer: str) -> str:
        return self.stored.get(consumer, "")

    def _store(self, consumer: str, cursor: str) -> None:
        old = self.stored.get(consumer)
        self._check(consumer, old, cursor)
        self.stored[consumer] = cursor

    def _check(self, consumer: str, old: str | None, cursor: str) -> None:
        if old is not None and self._key(cursor) <= self._key(old):
            raise CursorNotIncreasing(f"{consumer}: {cursor} after {old}")

    def set(self, consumer: str, cursor: str) -> None:
        self._key(cursor)
        with self._lock:
            self._raise()
            self.waiting[consumer] = cursor
            if self.buffered and self.period and self._timer is None:
                self._timer = threading.Timer(self.period, self._on_time)
                self._timer.daemon = True
                self._timer.start()
        if not self.buffered:
            self.flush()

    def _raise(self) -> None:
        failure, self._failure = self._failure, None
        if failure is not None:
            raise failure

    def _on_time(self) -> None:
        try:
            self.flush()
        except Exception as e:
            self._failure = e

    def flush(self) -> None:
        with self._lock:
            if self._timer is not None:
                self._timer.cancel()
                self._timer = None
            self._raise()
            # Detached first: what a failing flush has not written is lost, and is read again.
            waiting, self.waiting = self.waiting, {}
            for consumer, cursor in waiting.items():
                self._store(consumer, cursor)
                if self.on_set:
                    self.on_set(consumer)


class TableCursors(BufferedCursors):
    """Cursors that outlive the session: a table in a folder on any file system that Spark writes.

    A consumer's cursor is a small record; each set creates its next version and fails if another
    writer was first with a cursor that is not below. ``table`` shows the store as a table with
    ``columns``' names."""

    def __init__(self, spark: SparkSession, url: str, *, columns: CursorColumns = CursorColumns(), period: float | None = FLUSH_PERIOD, **options):
        super().__init__(period=period, **options)
        self.spark, self.url, self.columns = spark, url, columns
        self.records = Versions(spark, url)

    def clone(self, **changes) -> "TableCursors":
        same = {"columns": self.columns, "period": self.period, "strings": self.strings, "buffered": self.buffered, "on_set": self.on_set, "rank": self.rank}
        return TableCursors(self.spark, changes.pop("url", self.url), **same | changes)

    def get(self, consumer: str) -> str:
        raw = self.records.last(consumer)[1]
        return json.loads(raw)["cursor"] if raw else ""

    def _store(self, consumer: str, cursor: str) -> None:
        while True:
            number, raw = self.records.last(consumer)
            self._check(consumer, json.loads(raw)["cursor"] if raw else None, cursor)
            record = {"consumer": consumer, "cursor": cursor, "updated_at": datetime.now(timezone.utc).isoformat(), "version": number + 1}
            if self.records.create(consumer, number + 1, json.dumps(record).encode()):
                return

    def table(self) -> DataFrame:
        c = self.columns
        if not self.records.names():
            return self.spark.createDataFrame([], f"`{c.consumer}` string, `{c.cursor}` string, `{c.updated_at}` timestamp")
        rows = self.spark.read.schema("consumer string, cursor string, updated_at timestamp, version long").option("recursiveFileLookup", "true").json(self.url)
        last = rows.where("version IS NOT NULL").groupBy("consumer").agg(F.max_by(F.struct("cursor", "updated_at"), "version").alias("x"))
        return last.select(F.col("consumer").alias(c.consumer), F.col("x.cursor").alias(c.cursor), F.col("x.updated_at").alias(c.updated_at))


class ReadThroughCursors:
    def __init__(self, primary, fallback):
        self.primary, self.fallback = primary, fallback

    def get(self, consumer: str) -> str:
        cursor = self.primary.get(consumer)
        if not cursor and (cursor := self.fallback.get(consumer)):
            self.primary.set(consumer, cursor)
        return cursor

    def set(self, consumer: str, cursor: str) -> None:
        self.primary.set(consumer, cursor)

    def flush(self) -> None:
        self.primary.flush()
