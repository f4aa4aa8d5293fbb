"""Ways to consume a live log: own acknowledgement, batches, rows in tasks, shards, awaiting.

Each gives a Consumer or Specs for ``run``, which starts behind the stored cursor: what a consumer did
not acknowledge, or held in an open batch, is read again.
"""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterable, Iterator, Sequence
from dataclasses import dataclass, field, replace
from datetime import timedelta
from multiprocessing.pool import ThreadPool

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.errors import FilterError, InvalidBatchConfig, Stopped, is_expected
from logweir.operators import shards
from logweir.operators.filters import consumer_outcome, outcome
from logweir.operators.progress import Spans
from logweir.operators.waiting import awaited
from logweir.options import StreamOptions
from logweir.schema import EVENT
from logweir.streaming import batches
from logweir.streaming.run import Consumer, CursorStore, Spec


def acknowledging(name: str, consume: Callable[[DataFrame, Callable[[int], None]], None], cursors: CursorStore, **options) -> Consumer:
    """The function gets an ``ack(event id)`` that stores the cursor at once; nothing else moves it."""

    def ack(event_id: int) -> None:
        cursors.set(name, str(event_id))
        cursors.flush()

    return Consumer(name, lambda batch, _: consume(batch, ack), sets_cursor=False, **options)


@dataclass
class BatchConsumer(Consumer):
    """Hands over batches of a length, or of a period from their first event, across micro-batches.

    The events that pass the consumer's filters go to a stateful operator that holds the open batch
    (``streaming.batches``); a timer closes a batch that no event closes. ``consume`` gets the closed
    batches in order, each as a DataFrame; with ``together``, all that a micro-batch closed at once, told apart
    by the column ``batch``. The cursor follows closed batches alone, so a run that ends in an open batch
    reads it again. One consumer's events pass one task; ``Spec.limit`` bounds a micro-batch."""

    cursors: CursorStore | None = None
    length: int = 0
    period: timedelta = timedelta(0)
    together: bool = False
    #: Told how many events are held after each micro-batch.
    buffered: Callable[[int], None] | None = None
    sets_cursor: bool = False

    def __post_init__(self):
        if self.length <= 0 and self.period <= timedelta(0):
            raise InvalidBatchConfig("a batch needs a length or a period")

    def shape(self, stream: DataFrame) -> DataFrame:
        return batches.closed(passed(self, stream), length=self.length, period=self.period)

    def __call__(self, closed: DataFrame, batch_id: int) -> None:
        self.guarded(lambda: self.hand_over(closed))

    def hand_over(self, closed: DataFrame) -> None:
        rows = closed.where("id IS NOT NULL")
        # One row a batch.
        spans = [] if self.together else rows.groupBy("batch").agg(F.max("id").alias("last")).collect()
        for span in sorted(spans, key=lambda r: r["last"]):
            self.consume(rows.where(F.col("batch") == span["batch"]).select(*EVENT.names).orderBy("id"))
            self.cursors.set(self.name, str(span["last"]))
        if self.together and (last := rows.agg(F.max("id")).first()[0]) is not None:
            self.consume(rows.select("batch", *EVENT.names).orderBy("id"))
            self.cursors.set(self.name, str(last))
        self.cursors.flush()
        held = closed.where("id IS NULL").agg(F.sum("held")).first()[0]
        if self.buffered and held is not None:
            self.buffered(held)


def passed(consumer: Consumer, stream: DataFrame) -> DataFrame:
    """The events of a stream that pass a consumer's filters; a filter that fails fails the stream."""
    kind = consumer_outcome(consumer.types, consumer.event_filter)
    failed = F.raise_error(F.lit(f"{FilterError.__name__}: {consumer.name}")).cast("boolean")
    return stream.where(F.when(kind == "failed", failed).otherwise(kind == "processed"))


def in_tasks(batch: DataFrame, handle: Callable[[dict], None], *, retries: int | None = None) -> DataFrame:
    """(id, tries, error, expected) of a function run on every event, side by side in the tasks of a job.

    With ``retries`` an event that keeps failing is given up after so many more tries. ``expected``
    tells errors that end a run in the ordinary way."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for row in b.to_pylist():
                tries, error, expected = 0, None, False
                while tries <= (retries or 0):
                    tries += 1
                    try:
                        handle(row)
                        error, expected = None, False
                        break
                    except Exception as e:
                        error, expected = f"{type(e).__name__}: {e}", is_expected(e)
                out.append((row["id"], tries, error, expected))
            columns = zip(*out, strict=True) if out else [[]] * 4
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.bool_())
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, kinds, strict=True)], names=["id", "tries", "error", "expected"])

    return batch.mapInArrow(run, "id long, tries long, error string, expected boolean")


@dataclass
class ConcurrentConsumer(Consumer):
    """Events in any order, side by side in tasks; the cursor is the last event with no failed one, and none
    that is still at work, before it.

    At most ``max_in_flight`` events of a micro-batch are handled at a time, by default one a core. With
    ``ahead``, so many micro-batches may be at work besides the newest: a slow event holds up the cursor, not
    the events behind it. An error ends the run with the next micro-batch, or at the run's end."""

    cursors: CursorStore | None = None
    max_in_flight: int | None = None
    ahead: int = 0
    sets_cursor: bool = False

    def __post_init__(self):
        self._lock, self._moved = threading.Lock(), threading.Condition()
        self._restart()

    def _restart(self) -> None:
        self.spans, self.at_work, self.failure = Spans(), 0, None

    def begin(self) -> None:
        """Before a run: what an earlier one left undone is read again."""
        self._restart()

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        self.guarded(lambda: self._take(passed(self, batch)))

    def _take(self, batch: DataFrame) -> None:
        self._raise()
        if not self.ahead:
            self._work(batch, None)
            self._raise()
            return
        with self._moved:
            while self.at_work > self.ahead:
                self._moved.wait()
            self._raise()
            self.at_work += 1
        # The engine lets go of the micro-batch when this returns.
        batch = batch.persist()
        last = batch.agg(F.max("id")).first()[0]
        if last is None:
            self._left(batch)
            return
        span = self.spans.begin(last)
        threading.Thread(target=self._work, args=(batch, span), daemon=True).start()

    def _left(self, batch: DataFrame) -> None:
        batch.unpersist()
        with self._moved:
            self.at_work -= 1
            self._moved.notify_all()

    def _work(self, batch: DataFrame, span: list | None) -> None:
        try:
            top, failure = self._handled(batch)
            with self._lock:
                if span is not None and failure is None:
                    top = self.spans.done(span)
                elif span is not None and (self.spans.spans[0] is not span):
                    # Something before the failed micro-batch is at work.
                    top = None
                if top is not None and top > int(self.cursors.get(self.name) or 0):
                    self.cursors.set(self.name, str(top))
                self.failure = self.failure or failure
        except Exception as e:
            self.failure = self.failure or e
        finally:
            if span is not None:
                self._left(batch)

    def _handled(self, batch: DataFrame) -> tuple[int | None, Exception | None]:
        """The last event with no failed one before it, and the first failure."""
        if self.max_in_flight:
            batch = batch.coalesce(self.max_in_flight)
        done = in_tasks(batch, self.consume).persist()
        try:
            bad = done.where("error IS NOT NULL").agg(F.min("id").alias("id"), F.min_by("error", "id").alias("error"), F.min_by("expected", "id").alias("expected")).first()
            good = done if bad["id"] is None else done.where(F.col("id") < bad["id"])
            top = good.agg(F.max("id")).first()[0]
        finally:
            done.unpersist()
        if bad["id"] is None:
            return top, None
        # An expected end of a task is one of the run.
        return top, (Stopped if bad["expected"] else RuntimeError)(f"event {bad['id']}: {bad['error']}")

    def _raise(self) -> None:
        failure, self.failure = self.failure, None
        if failure is not None:
            raise failure

    def settle(self) -> None:
        """Waits for what is at work."""
        with self._moved:
            while self.at_work:
                self._moved.wait()
        self.cursors.flush()
        self._raise()


def concurrent(name: str, handle: Callable[[dict], None], cursors: CursorStore, *, max_in_flight: int | None = None, ahead: int = 0, **options) -> ConcurrentConsumer:
    return ConcurrentConsumer(name, handle, cursors=cursors, max_in_flight=max_in_flight, ahead=ahead, **options)


def dead_letter(name: str, handle: Callable[[dict], None], record: Callable[[DataFrame], None] | None, *, retries: int = 0, **options) -> Consumer:
    """Events that fail after their retries are recorded (consumer, event_id, error_msg) and passed over.

    Without a recorder they are only passed over, as expected errors always are. If recording fails,
    the batch fails. ``consumer.counts["dead_letters"]`` counts what was recorded."""

    def consume(batch: DataFrame, _: int) -> None:
        done = in_tasks(batch, handle, retries=retries).persist()
        try:
            # Every event is handled, whatever the recorder reads.
            done.count()
            lost = done.where("error IS NOT NULL AND NOT expected").select(F.col("id").alias("seq"), F.lit(name).alias("consumer"), F.col("id").alias("event_id"), F.col("error").alias("error_msg"), F.current_timestamp().alias("at"))
            if record:
                record(lost)
                consumer.counts["dead_letters"] = consumer.counts.get("dead_letters", 0) + lost.count()
        finally:
            done.unpersist()

    consumer = Consumer(name, consume, **options)
    return consumer


@dataclass(frozen=True)
class ConsumerShard:
    """One of n consumers side by side: its name, its number from 0, and the events that are its own."""

    name: str
    number: int
    total: int
    by: str | Column = shards.BY_ID

    def event_filter(self) -> Column:
        return outcome(shards.shard(self.total, self.by) == self.number + 1)

    def wire(self, consumer: Consumer) -> Consumer:
        """The consumer under the shard's name, for the shard's events."""
        return replace(consumer, name=self.name, event_filter=self.event_filter())


def consumer_shards(base: str, n: int, *, by: str | Column = shards.BY_ID, formatter: Callable[[str, int, int], str] | None = None) -> list[ConsumerShard]:
    return [ConsumerShard(name, m, n, by) for m, name in enumerate(shards.shard_names(base, n, formatter))]


@dataclass
class Fleet(Consumer):
    """The consumers of all shards over one scan of the log.

    The offset is the vector of the members' cursors: the scan starts behind the least, and a member gets
    the events of its shard behind its own, so that one that lags replays alone. Members work side by side on a
    micro-batch; the cursors of those that return are set, then the failure of another ends the run."""

    members: list[Consumer] = field(default_factory=list)
    cursors: CursorStore | None = None
    by: str | Column = shards.BY_ID

    def __post_init__(self):
        self.failures: dict[str, Exception] = {}
        if self.batching and len({(type(m), m.length, m.period) for m in self.members}) > 1:
            raise InvalidBatchConfig("batches of all shards have one length and period")

    @property
    def batching(self) -> bool:
        return any(isinstance(m, BatchConsumer) for m in self.members)

    @property
    def shape(self):
        return self._batches if self.batching else None

    @property
    def keys(self) -> int:
        return len(self.members)

    def _cursor(self, member: Consumer) -> int:
        return int(self.cursors.get(member.name) or 0)

    def start(self, cursors: CursorStore) -> int:
        return min(map(self._cursor, self.members))

    def _sharded(self, events: DataFrame) -> DataFrame:
        """The events with their shard, without those that their member has had."""
        behind = F.array(*[F.lit(self._cursor(m)) for m in self.members])
        rows = events.withColumn("shard", shards.shard(len(self.members), self.by))
        return rows.where(F.col("id") > F.element_at(behind, F.col("shard").cast("int")))

    def _batches(self, stream: DataFrame) -> DataFrame:
        rows, first = self._sharded(stream), self.members[0]
        kept = None
        for m, member in enumerate(self.members):
            one = F.when(F.col("shard") == m + 1, consumer_outcome(member.types, member.event_filter))
            kept = one if kept is None else F.coalesce(kept, one)
        failed = F.raise_error(F.lit(f"{FilterError.__name__}: {self.name}")).cast("boolean")
        rows = rows.where(F.when(kept == "failed", failed).otherwise(kept == "processed"))
        return batches.closed(rows, length=first.length, period=first.period, part=F.col("shard"))

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        column, rows = ("part", batch) if self.batching else ("shard", self._sharded(batch).persist())
        self.failures = {}

        def one(m: int) -> None:
            try:
                self.members[m](rows.where(F.col(column) == m + 1).drop("shard"), batch_id)
            except Exception as e:
                self.failures[self.members[m].name] = e

        try:
            with ThreadPool(min(len(self.members), 16)) as pool:
                pool.map(one, range(len(self.members)))
        finally:
            rows.unpersist()
        if self.batching:
            self._raise()

    def advance(self, cursors: CursorStore, top: int) -> int:
        moved = 0
        for member in self.members:
            if member.sets_cursor and member.name not in self.failures and top > self._cursor(member):
                cursors.set(member.name, str(top))
                moved += 1
        # The next micro-batch compares with what is stored.
        cursors.flush()
        self._raise()
        return moved

    def _raise(self) -> None:
        for failure in self.failures.values():
            raise failure


def parallel(base: Spec, n: int, consumer: Callable[[int, str], Consumer], *, by=shards.BY_ID, formatter: Callable[[str, int, int], str] | None = None, options: StreamOptions | None = None, consumer_options: Callable[[int], dict] | None = None) -> Spec:
    """One spec for n consumers of a shard each, which share one scan (``Fleet``).

    ``options`` go to the stream, ``consumer_options`` to the consumer of a shard's number."""
    names = shards.shard_names(base.consumer.name, n, formatter)
    members = []
    for m, name in enumerate(names):
        members.append(replace(consumer(m, name), name=name, **(consumer_options(m) if consumer_options else {})))

    def every(hook: str):
        return lambda: [getattr(m, hook)() for m in members if getattr(m, hook)]

    fleet = Fleet(base.consumer.name, base.consumer.consume, sets_cursor=False, members=members, cursors=base.cursors, by=by, reset=every("reset"), stop=every("stop"))
    return replace(base, consumer=fleet, options=options or base.options)


def parallel_ack(base: Spec, n: int, consume: Callable[[DataFrame, Callable[[int], None]], None], **options) -> Spec:
    """The same with consumers that acknowledge by themselves."""
    return parallel(base, n, lambda _, name: acknowledging(name, consume, base.cursors), **options)


def parallel_specs(base: Spec, n: int, consumer: Callable[[int, str], Consumer], *, by=shards.BY_ID, formatter: Callable[[str, int, int], str] | None = None, options: StreamOptions | None = None, consumer_options: Callable[[int], dict] | None = None) -> list[Spec]:
    """One spec a shard, for consumers that run apart, on clusters of their own: each reads the log.

    Where they run in one program, ``parallel`` reads it once."""
    specs = []
    for own in consumer_shards(base.consumer.name, n, by=by, formatter=formatter):
        made = own.wire(consumer(own.number, own.name))
        made = replace(made, **(consumer_options(own.number) if consumer_options else {}))
        specs.append(replace(base, consumer=made, options=options or base.options))
    return specs


def parallel_ack_specs(base: Spec, n: int, consume: Callable[[DataFrame, Callable[[int], None]], None], **options) -> list[Spec]:
    """The same with consumers that acknowledge by themselves."""
    return parallel_specs(base, n, lambda _, name: acknowledging(name, consume, base.cursors), **options)


def wait_for(log: Callable[[], DataFrame], head: int, foreign_id: str, types: Sequence[int], *, poll: Callable[[], bool] | None = None, period: float = 1.0, timeout: float = 15.0, sleep: Callable[[float], None] = time.sleep):
    """Blocks until an event for an entity comes behind the head, or ``poll`` says that it is done."""
    end = time.monotonic() + timeout
    while True:
        found = awaited(log(), head, foreign_id, types).first()
        if found is not None or poll is not None and poll():
            return found
        if time.monotonic() >= end:
            raise TimeoutError(f"no event for {foreign_id}")
        sleep(period)


def wait_for_cursor(cursors: CursorStore, consumer: str, event_id: int, *, timeout: float = 15.0, period: float = 0.05) -> None:
    """Blocks until a consumer's cursor has come to an event."""
    end = time.monotonic() + timeout
    while int(cursors.get(consumer) or 0) < event_id:
        if time.monotonic() >= end:
            raise TimeoutError(f"{consumer} is at {cursors.get(consumer)!r}")
        time.sleep(period)
