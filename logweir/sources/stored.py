"""Logs that are written to: appended events, consumer errors, and the filling of holes.

What a log holds is told by its commit log (``commits``), beside its files. An append reserves its ids,
writes its files, and commits both the files and the end of the reservation as one record; until then
nobody sees them. A writer that fails ends its reservation, and its ids are a hole. One that dies, or
takes longer than its lease without a sign of life, may have its ids taken over by the gap filler, which
ends the reservation in the record that adds the no-ops; when the writer comes back, its commit fails, and
it appends anew with other ids. So every id is written once, however late a writer is.
"""

from __future__ import annotations

import re
import threading
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field, replace
from datetime import timedelta
from urllib.parse import unquote

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.commits import CommitLog, DataFile, Snapshot
from logweir.errors import ReservationLost
from logweir.functions.traces import current_trace
from logweir.operators import gaps, log, retries
from logweir.schema import ERROR, EVENT, ErrorColumns, EventColumns
from logweir.storage import delete
from logweir.streaming.notify import Notifier

#: Writes rows, with the table's own column names, to a new folder.
Inserter = Callable[[DataFrame, str], None]
#: How long a reservation is left alone after its writer's last sign of life.
LEASE = timedelta(seconds=60)
#: Times an append begins anew after its ids were taken over.
ATTEMPTS = 5


def append_parquet(rows: DataFrame, path: str) -> None:
    rows.write.mode("append").parquet(path)


def _is_there(spark: SparkSession, url: str) -> bool:
    path = spark._jvm.org.apache.hadoop.fs.Path(url)
    return path.getFileSystem(spark._jsc.hadoopConfiguration()).exists(path)


def _below(spark: SparkSession, root: str, found: str) -> str:
    """A file's path, as Spark tells it, below the folder ``root``."""
    path = spark._jvm.org.apache.hadoop.fs.Path(root)
    whole = path.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(path).toString()
    one_slash = lambda url: re.sub("^([a-z0-9]+):/+", r"\1:/", url)
    base, found = one_slash(whole).rstrip("/") + "/", one_slash(unquote(found))
    if not found.startswith(base):
        raise ValueError(f"{found} is not below {base}")
    return found[len(base) :]


def _measured(spark: SparkSession, root: str, name: str, id_: str, time_: str | None) -> list[DataFile]:
    """The files of the folder ``name`` of a table, with their ids; paths are below ``root``."""
    folder = f"{root}/{name}" if name else root
    if not _is_there(spark, folder):
        return []
    rows = spark.read.parquet(folder)
    if id_ not in rows.columns:
        return []
    newest = F.max(F.unix_micros(F.col(f"`{time_}`").cast("timestamp"))) if time_ else F.lit(None).cast("long")
    found = rows.groupBy(F.col("_metadata.file_path").alias("path")).agg(F.min(f"`{id_}`").cast("long").alias("first"), F.max(f"`{id_}`").cast("long").alias("last"), F.count(F.lit(1)).alias("n"), newest.alias("newest"))
    # One row a file of one batch.
    return sorted((DataFile(_below(spark, root, r["path"]), r["first"], r["last"], r["n"], r["newest"]) for r in found.collect()), key=lambda f: f.first)


def _added(files: list[DataFile]) -> list[list]:
    return [[f.path, f.first, f.last, f.rows, f.newest] for f in files]


class Renewal:
    """Renews a reservation on a thread of its own while its writer is at work."""

    def __init__(self, commits: CommitLog, table: str, token: str, period: float):
        self.commits, self.table, self.token, self.period = commits, table, token, period
        self._stop = threading.Event()
        self._thread = threading.Thread(target=self._run, daemon=True)

    def _run(self) -> None:
        while not self._stop.wait(self.period):
            try:
                self.commits.commit(lambda now: {self.table: {"renew": [self.token]}})
            except Exception:
                # Taken over, or not reachable; the writer's own commit finds out.
                return

    def __enter__(self) -> "Renewal":
        self._thread.start()
        return self

    def __exit__(self, *_) -> None:
        self._stop.set()
        self._thread.join()


@dataclass(frozen=True)
class StoredLog:
    """An event table in a folder. Its commit log is ``commits_url``, by default ``_log`` in the folder;
    one commit log may tell of several tables, by ``table``.

    A folder of files without a commit log is read as it is; the first append takes its files in. An
    inserter of one's own writes to the folder that it is given; if it writes elsewhere, the ids are given up."""

    spark: SparkSession
    path: str
    columns: EventColumns = EventColumns(metadata="metadata", trace="trace")
    inserter: Inserter = append_parquet
    notifier: Notifier | None = None
    commits_url: str | None = None
    table: str = "events"
    lease: timedelta = LEASE
    commits: CommitLog = field(init=False, compare=False, repr=False)

    def __post_init__(self):
        object.__setattr__(self, "path", self.path.rstrip("/"))
        object.__setattr__(self, "commits", CommitLog(self.spark, self.commits_url or f"{self.path}/_log"))

    def clone(self, **changes) -> "StoredLog":
        return replace(self, **changes)

    def _read(self, *paths: str) -> DataFrame:
        fields = ", ".join(f"`{getattr(self.columns, f.name)}` {f.dataType.simpleString()}" for f in EVENT if getattr(self.columns, f.name))
        return self.columns.read(self.spark.read.schema(fields).parquet(*paths))

    def events(self, after: int = 0) -> DataFrame:
        """The committed events, with canonical names; those behind a cursor, from their files only."""
        now = self.commits.snapshot()
        if now.version:
            paths = [f"{self.path}/{f.path}" for f in now.table(self.table).files if f.last > after]
        else:
            paths = [self.path] if _is_there(self.spark, self.path) else []
        rows = self._read(*paths) if paths else self.spark.createDataFrame([], EVENT)
        return log.after(rows, after) if after else rows

    def log(self, **options) -> log.EventLog:
        return log.EventLog(lambda _: self.events(), EventColumns(metadata="metadata", trace="trace"), **options)

    def adopt(self) -> None:
        """Takes in the files of a folder that has no commit log yet."""
        if self.commits.snapshot().version:
            return
        files = self.measured("")
        self.commits.commit(lambda now: None if now.version else {self.table: {"add": _added(files)}})

    def reserve(self, n: int) -> tuple[str, int]:
        """Takes the next n ids; gives a token, and the id before them."""
        self.adopt()
        token, before = uuid.uuid4().hex, 0

        def change(now: Snapshot) -> dict:
            nonlocal before
            before = now.table(self.table).upto
            return {self.table: {"reserve": {token: [before + 1, before + n]}}}

        self.commits.commit(change)
        return token, before

    def release(self, token: str) -> None:
        """Ends a reservation whose events will not come; if it is not open any more, nothing."""
        self.commits.commit(lambda now: {self.table: {"end": [token]}} if now.table(self.table).reserved(token) else None)

    def measured(self, name: str) -> list[DataFile]:
        """The files of a folder below the table's."""
        return _measured(self.spark, self.path, name, self.columns.id, self.columns.timestamp)

    def _write(self, rows: DataFrame, n: int, now: Column | None) -> None:
        token, before = self.reserve(n)
        name = f"batch-{token}"
        folder = f"{self.path}/{name}"
        try:
            with Renewal(self.commits, self.table, token, self.lease.total_seconds() / 3):
                self.inserter(self.columns.write(log.new_events(self.spark, rows, before, self.columns, now)), folder)
                files = self.measured(name)
            self.commits.commit(lambda _: {self.table: {"end": [token], "add": _added(files)}})
        except Exception:
            self.release(token)
            delete(self.spark, folder)
            raise

    def append(self, rows: DataFrame, *, now: Column | None = None) -> Callable[[], None]:
        """Appends rows (seq, foreign_id, type, optional metadata and trace) in order of seq.

        A no-op fails before anything is written, as does metadata without a column for it. Where the
        log has a trace column and rows have none, the trace that is current here is stored. Gives
        the function that wakes the log's readers, to be called once the rows are to be seen."""
        if self.columns.trace and "trace" not in rows.columns and (trace := current_trace()):
            rows = rows.withColumn("trace", F.lit(bytearray(trace)))
        rows = rows.persist()
        try:
            checked = log.new_events(self.spark, rows, 0, self.columns, now)
            n, _ = checked.agg(F.count(F.lit(1)), F.max(F.length("foreign_id"))).first()
            for attempt in range(1, ATTEMPTS + 1) if n else ():
                try:
                    self._write(rows, n, now)
                    break
                except ReservationLost:
                    if attempt == ATTEMPTS:
                        raise
        finally:
            rows.unpersist()
        return self.notifier.notify if self.notifier else lambda: None

    def insert(self, foreign_id: str, type_: int, metadata: bytes | None = None) -> Callable[[], None]:
        """Appends one event."""
        schema, row = "seq long, foreign_id string, type int", [1, foreign_id, type_]
        if metadata is not None:
            schema, row = schema + ", metadata binary", [*row, bytearray(metadata)]
        return self.append(self.spark.createDataFrame([tuple(row)], schema))


class _Overtaken(Exception):
    """Another record came in between."""


@dataclass
class ErrorStore:
    """Errors of consumers: a table of one row a (consumer, event), and a log of an event a call.

    ``record`` suits ``patterns.dead_letter``. Rows and events of a call are one record of one commit
    log, so both are there or neither. Rows are merged by key against the errors that were committed when the
    merge began; if another recorder commits first, the files are thrown away and merged again against its
    rows. So a key has one row, and ids of both tables have no holes."""

    spark: SparkSession
    path: str
    columns: ErrorColumns = ErrorColumns()
    record_only: bool = False
    inserter: Inserter = append_parquet
    event_inserter: Inserter = append_parquet
    counter: Callable[[str, int], None] | None = None
    notifier: Notifier | None = None
    events: StoredLog = field(init=False)

    def __post_init__(self):
        self.path = self.path.rstrip("/")
        self.events = StoredLog(self.spark, f"{self.path}_events", EventColumns(metadata="metadata"), self.event_inserter, self.notifier, commits_url=f"{self.path}/_log")

    @property
    def commits(self) -> CommitLog:
        return self.events.commits

    def errors(self, now: Snapshot | None = None) -> DataFrame:
        """The error rows with canonical names."""
        files = [f"{self.path}/{f.path}" for f in (now or self.commits.snapshot()).table("errors").files]
        if not files:
            return self.spark.createDataFrame([], ERROR)
        fields = ", ".join(f"`{getattr(self.columns, f.name)}` {f.dataType.simpleString()}" for f in ERROR)
        rows = self.spark.read.schema(fields).parquet(*files)
        return rows.select(*[F.col(f"`{getattr(self.columns, f.name)}`").alias(f.name) for f in ERROR])

    def _merge(self, calls: DataFrame) -> None:
        """One try: writes what the calls add to the errors as they are, and commits it."""
        now, token = self.commits.snapshot(), uuid.uuid4().hex
        name = f"batch-{token}"
        known, folders = self.errors(now), [f"{self.path}/{name}", f"{self.events.path}/{name}"]
        fresh = retries.recorded(calls, known, now.table("errors").upto + 1)
        try:
            self.inserter(self.columns.write(fresh), folders[0])
            files = {"errors": _measured(self.spark, self.path, name, self.columns.id, self.columns.created_at)}
            if not self.record_only:
                # What was written, not what would be written again.
                names = {getattr(self.columns, f.name): f.name for f in ERROR}
                written = [f"{self.path}/{f.path}" for f in files["errors"]]
                rows = known.unionByName(self.spark.read.parquet(*written).withColumnsRenamed(names)) if written else known
                events = retries.error_events(calls, rows, now.table("events").upto + 1)
                events = events.select(*[F.col(f.name) if f.name in events.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in EVENT])
                self.event_inserter(self.events.columns.write(events), folders[1])
                files["events"] = self.events.measured(name)

            def change(then: Snapshot) -> dict:
                if then.version != now.version:
                    raise _Overtaken
                return {name: {"add": _added(f)} for name, f in files.items() if f}

            self.commits.commit(change)
        except BaseException:
            for folder in folders:
                delete(self.spark, folder)
            raise

    def record(self, calls: DataFrame) -> None:
        """Calls (seq, consumer, event_id, error_msg, at); those without any do nothing."""
        calls = calls.withColumn("event_id", F.col("event_id").cast("string")).persist()
        try:
            counts = calls.groupBy("consumer").count().collect()
            while counts:
                try:
                    self._merge(calls)
                    break
                except _Overtaken:
                    continue
            if counts and self.notifier and not self.record_only:
                self.notifier.notify()
            for consumer, n in counts:
                if self.counter:
                    self.counter(consumer, n)
        finally:
            calls.unpersist()


class GapListener:
    """Tells handlers of the holes in a log, as a DataFrame (prev, next), on a thread of its own.

    ``counter`` is told how many holes a look found, ``listening`` whether the thread runs."""

    def __init__(self, events: Callable[[], DataFrame], cursor: int = 0, *, period: float = 1.0, counter: Callable[[int], None] | None = None, listening: Callable[[bool], None] | None = None):
        self.events, self.cursor, self.period, self.counter, self.listening = events, cursor, period, counter, listening
        self.handlers: list[Callable[[DataFrame], None]] = []
        self._stop, self._thread = threading.Event(), None
        self.failure: Exception | None = None

    def listen(self, handler: Callable[[DataFrame], None]) -> None:
        self.handlers.append(handler)

    def poll(self) -> bool:
        """Looks once; whether there are holes."""
        found = gaps.gaps(self.events(), self.cursor).persist()
        try:
            n = found.count()
            if self.counter:
                self.counter(n)
            if n:
                for handler in self.handlers:
                    handler(found)
            return n > 0
        finally:
            found.unpersist()

    def start(self) -> "GapListener":
        def loop():
            if self.listening:
                self.listening(True)
            try:
                while not self._stop.is_set():
                    self.poll()
                    self._stop.wait(self.period)
            except Exception as e:
                self.failure = e
            finally:
                if self.listening:
                    self.listening(False)

        self._thread = threading.Thread(target=loop, daemon=True)
        self._thread.start()
        return self

    def stop(self) -> None:
        """Ends the thread; without one, only keeps it from being started."""
        self._stop.set()
        if self._thread is not None:
            self._thread.join()


class GapFiller:
    """Closes holes with no-op events in the log itself.

    Ids of a reservation that was ended without events are filled at once. Those of an open one
    are left alone until its writer has given no sign of life for ``lease``; then the record that adds the
    no-ops ends the reservation, and the writer can no longer commit. With a ``grace`` (an interval) every
    hole also waits until the event behind it is older: for logs whose files come from writers that reserve
    nothing. A filler that a writer or another filler overtakes adds nothing; the next look finds what is left."""

    def __init__(self, target: StoredLog, *, lease: timedelta | None = None, grace: Column | None = None, counter: Callable[[int], None] | None = None, clock: Callable[[], float] = time.time):
        self.target, self.grace, self.counter, self.clock = target, grace, counter, clock
        self.lease = target.lease if lease is None else lease

    def __call__(self, holes: DataFrame) -> None:
        target = self.target
        target.adopt()
        now = target.commits.snapshot()
        state = now.table(target.table)
        silent = int((self.clock() - self.lease.total_seconds()) * 1e6)
        waiting = {token: (a, b) for token, (a, b, seen) in state.open.items() if seen > silent}
        events = target.events()
        rows = gaps.fillers(events, holes, older_than=None if self.grace is None else F.current_timestamp() - self.grace)
        # A reservation is one writer at work: few enough for a condition each.
        for a, b in waiting.values():
            rows = rows.where(~F.col("id").between(a, b))
        name = f"batch-{uuid.uuid4().hex}"
        target.inserter(target.columns.write(rows), f"{target.path}/{name}")
        files = target.measured(name)

        def meet(first: int, last: int) -> bool:
            return any(f.first <= last and first <= f.last for f in files)

        taken = [t for t, (a, b, _) in state.open.items() if t not in waiting and meet(a, b)]

        def change(then: Snapshot) -> dict | None:
            # What was filled must still be a hole: nothing came to it, and no writer came back.
            late = then.table(target.table)
            if any(meet(f.first, f.last) for f in late.files[len(state.files) :]) or any(late.open.get(t) != state.open[t] for t in taken):
                raise _Overtaken
            return {target.table: {"end": taken, "add": _added(files)}} if files else None

        try:
            target.commits.commit(change)
        except (_Overtaken, ReservationLost):
            delete(target.spark, f"{target.path}/{name}")
            return
        if self.counter and files:
            self.counter(sum(f.rows for f in files))
        if target.notifier:
            target.notifier.notify()


def fill_gaps(target: StoredLog, *, cursor: int = 0, period: float = 1.0, found: Callable[[int], None] | None = None, listening: Callable[[bool], None] | None = None, counter: Callable[[int], None] | None = None, metrics=None, **options) -> GapListener:
    """A listener, to be started and stopped, that fills the log's holes.

    ``metrics`` is told how many holes block the log, were found and filled, and of the thread."""

    def both(own, tell):
        return lambda n: [f(n) for f in (own, tell if metrics else None) if f]

    def looked(n: int) -> None:
        metrics.gauge("blocking_gaps", target.path, n)
        metrics.add("gaps_detected", target.path, n)

    listener = GapListener(target.events, cursor, period=period, counter=both(found, looked), listening=both(listening, lambda on: metrics.gauge("gap_listeners", target.path, int(on))))
    listener.listen(GapFiller(target, counter=both(counter, lambda n: metrics.add("gaps_filled", target.path, n)), **options))
    return listener
