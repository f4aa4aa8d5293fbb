"""Runs a consumer over a log: at least once, in order, with a cursor that follows.

A spec names a stream, a cursor store and a consumer. Each micro-batch is handed over as a DataFrame;
its cursor is set after the consumer returns, so that a failure reads the batch again. Skipped
events move the cursor as consumed ones do.

The cursor store is all that a run remembers. Each run starts behind the stored cursor with a
streaming checkpoint of its own, which it removes: a checkpoint may be ahead of a consumer that
acknowledges by itself, and going on from it would lose what was not acknowledged.
"""

from __future__ import annotations

import re
import time
import uuid
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field, replace
from typing import Any, Protocol

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.errors import FilterError, NotIncreasing, is_expected
from logweir.operators.filters import consumer_outcome
from logweir.operators.health import ACTIVITY_TTL, LAG_ALERT
from logweir.operators.log import is_noop
from logweir.options import StreamOptions
from logweir.sources.cache import TailCache
from logweir.storage import delete
from logweir.streaming.metrics import Metrics
from logweir.streaming.notify import Notifier
from logweir.streaming.source import EventLogStreamReader, head_of, register

#: Seconds before a run is repeated after an expected error, and after any other; and between looks
#: at the head of a log whose readers are woken by a notifier.
EXPECTED_WAIT, FAILED_WAIT, BACKOFF = 0.1, 60.0, 10.0

#: Ids in a micro-batch of a query with state whose spec sets no limit: its operator holds a key's rows of one in a task.
STATE_IDS = 500_000

#: Settings of queries with state; the number of its partitions is that of its keys.
_STATE = {"spark.sql.streaming.stateStore.providerClass": "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider", "spark.sql.shuffle.partitions": ""}


class CursorStore(Protocol):
    def get(self, consumer: str) -> str: ...
    def set(self, consumer: str, cursor: str) -> None: ...
    def flush(self) -> None: ...


@dataclass
class Consumer:
    """A named function of (batch, batch id), with optional filters and hooks."""

    name: str
    consume: Callable[[DataFrame, int], None]
    types: Sequence[int] = ()
    event_filter: Column | None = None
    recover: Callable[[Exception], Exception | None] | None = None
    reset: Callable[[], None] | None = None
    stop: Callable[[], None] | None = None
    #: A consumer that acknowledges itself keeps the loop from setting its cursor.
    sets_cursor: bool = True
    counts: dict[str, int] = field(default_factory=dict)
    #: Seconds of lag that raise an alert, and of silence after which it counts as idle; none: not reported.
    lag_alert: float | None = LAG_ALERT
    activity_ttl: float | None = ACTIVITY_TTL

    #: What the stream is made to be before micro-batches are cut: a stateful operator, say.
    shape = None
    #: Keys of the state that ``shape`` has.
    keys = 1

    def begin(self) -> None:
        """Before a run."""

    def settle(self) -> None:
        """After a run: waits for what it left at work."""

    def start(self, cursors: CursorStore) -> int:
        """Where the consumer goes on."""
        return int(cursors.get(self.name) or 0)

    def advance(self, cursors: CursorStore, top: int) -> int:
        """After a micro-batch that ends at ``top``; how many cursors were set."""
        if not self.sets_cursor:
            return 0
        cursors.set(self.name, str(top))
        return 1

    def guarded(self, work: Callable[[], None]) -> None:
        """Does the work; an unexpected error goes through ``recover``, which may swallow it."""
        try:
            work()
        except Exception as e:
            left = self.recover(e) if self.recover and not is_expected(e) else e
            self.counts["errors"] = self.counts.get("errors", 0) + 1
            if left is not None:
                raise left from e

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        outcome = consumer_outcome(self.types, self.event_filter)

        def work():
            failed = batch.where(outcome == "failed").limit(1).count() if self.event_filter is not None else 0
            if failed:
                raise FilterError(self.name)
            self.consume(batch.where(outcome == "processed"), batch_id)

        self.guarded(work)


@dataclass
class Spec:
    path: str
    cursors: CursorStore
    consumer: Consumer
    options: StreamOptions = StreamOptions()
    source_options: dict[str, str] = field(default_factory=dict)
    include_noops: bool = False
    #: Ids in one micro-batch, at most; of queries with state ``STATE_IDS`` where none are given.
    limit: int | None = None
    metrics: Metrics | None = None
    #: Where the events of micro-batches are read, so that consumers of one log share a load.
    cache: TailCache | None = None

    def bootstrapped(self) -> "Spec":
        """From the head, unless there is a cursor."""
        none = not self.cursors.get(self.consumer.name)
        return replace(self, options=StreamOptions(self.options.lag, none, self.options.to_head))


class _Run:
    def __init__(self, spark: SparkSession, spec: Spec, checkpoint: str):
        self.spark, self.spec, self.checkpoint = spark, spec, checkpoint
        self.options = dict(spec.source_options) | spec.options.as_source_options()
        if spec.limit or spec.consumer.shape:
            self.options["limit"] = str(spec.limit or STATE_IDS)
        if spec.cache and not spec.consumer.shape:
            self.options["marks"] = "true"
        #: The end of what was handed over in this run.
        self.at = spec.consumer.start(spec.cursors)

    def step(self, batch: DataFrame, batch_id: int) -> None:
        spec, consumer = self.spec, self.spec.consumer
        if not spec.cache:
            batch = batch.persist()
        began = time.monotonic()
        try:
            top = batch.agg(F.max("id")).first()[0]
            if top is None:
                # A query that starts at the head begins with an empty batch.
                return
            if top <= self.at:
                raise NotIncreasing(f"{spec.consumer.name}: {top} after {self.at}")
            if spec.cache:
                batch = spec.cache.between(self.at, top)
            rows = batch if spec.include_noops else batch.where(~is_noop())
            try:
                consumer(rows.orderBy("id"), batch_id)
            finally:
                if spec.metrics:
                    spec.metrics.consumed(consumer, rows, time.monotonic() - began)
            sets = consumer.advance(spec.cursors, top)
            if spec.metrics and sets:
                spec.metrics.add("cursor_sets", consumer.name, sets)
            self.at = top
        finally:
            if not spec.cache:
                batch.unpersist()

    def shaped(self, batch: DataFrame, batch_id: int) -> None:
        """A micro-batch of a shaped stream, whose consumer sets its cursors itself."""
        batch, consumer, metrics = batch.persist(), self.spec.consumer, self.spec.metrics
        began = time.monotonic()
        try:
            consumer(batch, batch_id)
        finally:
            if metrics:
                # What open batches hold is told by rows without an id.
                held = batch.where("id IS NULL").agg(F.sum("held")).first()[0]
                if held is not None:
                    metrics.gauge("batch_buffered", consumer.name, held)
                metrics.consumed(consumer, batch.where("id IS NOT NULL"), time.monotonic() - began)
            batch.unpersist()

    def query(self, trigger: dict, timeout: float | None = None, until: Callable[[Any], bool] | None = None):
        """One streaming query from where the run is, to its end or until it is told to end."""
        place = f"{self.checkpoint}/{uuid.uuid4().hex}"
        consumer = self.spec.consumer
        if consumer.shape:
            # What was open in a query before is read again.
            self.at = consumer.start(self.spec.cursors)
        rows = self.spark.readStream.format("eventlog").options(path=self.spec.path, after=str(self.at), **self.options).load()
        kept = {k: self.spark.conf.get(k, None) for k in _STATE}
        step = self.step
        if consumer.shape:
            rows, step = consumer.shape(rows if self.spec.include_noops else rows.where(~is_noop())), self.shaped
            # A query keeps the settings that it was started with.
            for k, v in _STATE.items():
                self.spark.conf.set(k, v or str(consumer.keys))
        listener = self.spec.metrics.listener(consumer) if self.spec.metrics else None
        if listener:
            self.spark.streams.addListener(listener)
        try:
            query = rows.writeStream.queryName(consumer.name).option("checkpointLocation", place).foreachBatch(step).trigger(**trigger).start()
        finally:
            for k, v in kept.items() if consumer.shape else ():
                self.spark.conf.unset(k) if v is None else self.spark.conf.set(k, v)
        try:
            if until is None:
                query.awaitTermination(timeout)
            else:
                while query.isActive and not until(query):
                    time.sleep(0.02)
                if not query.isActive:
                    # One that ended by itself raises its error here.
                    query.awaitTermination()
        finally:
            query.stop()
            if listener:
                # The last progress is told before the end.
                listener.ended.wait(10)
                self.spark.streams.removeListener(listener)
            delete(self.spark, place)
        return query

    def drain(self):
        """To the head as it is now. Bounded batches are those of one query, whose source looks at the log's
        files once and plans one batch after the other from there."""
        self.options.pop("fromHead", None)
        if not self.spec.limit and not self.spec.consumer.shape:
            return self.query({"availableNow": True})
        whole = {k: v for k, v in self.options.items() if k != "limit"} | {"path": self.spec.path, "after": str(self.at)}
        target = EventLogStreamReader(whole).latestOffset()["after"]
        if not self.spec.limit and target - self.at <= STATE_IDS:
            # One micro-batch.
            del self.options["limit"]
            return self.query({"availableNow": True})
        if target <= self.at:
            return None

        def drained(query) -> bool:
            # Progress shows the offset as text; its one number is the cursor.
            last = query.lastProgress
            end = re.search("[0-9]+", last["sources"][0]["endOffset"] or "") if last else None
            return end is not None and int(end[0]) >= target

        return self.query({"processingTime": "0 seconds"}, until=drained)


def run(spark: SparkSession, spec: Spec, checkpoint: str, *, interval: str = "1 second", timeout: float | None = None, notifier: Notifier | None = None, backoff: float = BACKOFF) -> Any:
    """Runs until the query ends: at the head with ``to_head``, else when it is stopped or fails.

    With a notifier the run sleeps at the head until it is woken, or for ``backoff`` seconds."""
    register(spark)
    consumer, now = spec.consumer, _Run(spark, spec, checkpoint)
    end = None if timeout is None else time.monotonic() + timeout
    if consumer.reset:
        consumer.reset()
    if spec.metrics:
        spec.metrics.started(consumer)
    try:
        if spec.options.from_head and (spec.options.to_head or notifier):
            now.at = head_of(spec.path, **{k: v for k, v in spec.source_options.items() if k in ("commits", "table")})
        consumer.begin()
        if spec.options.to_head:
            query = now.drain()
            consumer.settle()
            return query
        # A query that holds state goes on; others end at the head, and are woken.
        if notifier is None or consumer.shape:
            return now.query({"processingTime": interval}, timeout)
        while end is None or time.monotonic() < end:
            woken = notifier.register()
            query = now.drain()
            woken.wait(backoff if end is None else max(0.0, min(backoff, end - time.monotonic())))
        return query
    finally:
        try:
            consumer.settle()
        finally:
            spec.cursors.flush()
        if consumer.stop:
            consumer.stop()
        if spec.metrics:
            spec.metrics.stopped(consumer)


def run_forever(start: Callable[[], Any], stop: Callable[[], None] | None = None, *, sleep: Callable[[float], None] = time.sleep, rounds: int | None = None) -> None:
    """Repeats a run: soon after an expected end, later after a failure."""
    done = 0
    while rounds is None or done < rounds:
        wait = EXPECTED_WAIT
        try:
            start()
        except Exception as e:
            wait = EXPECTED_WAIT if is_expected(e) else FAILED_WAIT
        finally:
            if stop:
                stop()
        done += 1
        sleep(wait)
