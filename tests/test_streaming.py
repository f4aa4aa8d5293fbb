"""The live source and the run loop: to head, restart, holes, lag, no-ops, failures."""

from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logweir import errors
from logweir.operators.cursors import BufferedCursors, MemoryCursors
from logweir.options import StreamOptions
from logweir.schema import EVENT
from logweir.streaming.run import Consumer, Spec, run, run_forever

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
TO_HEAD = StreamOptions(to_head=True)


def write(spark, path, ids, at=T0, kind=1, foreign="5"):
    spark.createDataFrame([(i, kind, foreign, at, None, None) for i in ids], EVENT).coalesce(1).write.mode("append").parquet(path)


class Collect(Consumer):
    def __init__(self, name, **options):
        self.seen: list[int] = []
        super().__init__(name, self.take, **options)

    def take(self, batch, batch_id):
        self.seen += [r["id"] for r in batch.collect()]


def test_drains_and_resumes(spark, tmp_path):
    path, cursors, consumer = str(tmp_path / "log"), BufferedCursors(), Collect("drain")
    write(spark, path, range(1, 6))
    spec = Spec(path, cursors, consumer, TO_HEAD, {"rangeIds": "2"})
    run(spark, spec, str(tmp_path / "cp"))
    assert consumer.seen == [1, 2, 3, 4, 5] and cursors.get("drain") == "5"
    write(spark, path, range(6, 9))
    run(spark, spec, str(tmp_path / "cp"))
    assert consumer.seen == list(range(1, 9)) and cursors.get("drain") == "8"
    # The cursor alone, without the checkpoint, is enough to go on.
    write(spark, path, [9])
    run(spark, spec, str(tmp_path / "cp2"))
    assert consumer.seen == list(range(1, 10))


def test_holes_block(spark, tmp_path):
    path, consumer = str(tmp_path / "log"), Collect("holes")
    write(spark, path, [100, 101, 103, 104])
    spec = Spec(path, MemoryCursors(), consumer, TO_HEAD)
    run(spark, spec, str(tmp_path / "cp"))
    assert consumer.seen == [100, 101]
    write(spark, path, [102], kind=0, foreign="0")
    run(spark, spec, str(tmp_path / "cp"))
    assert consumer.seen == [100, 101, 103, 104] and spec.cursors.get("holes") == "104"


def test_lag_withholds(spark, tmp_path):
    path, consumer = str(tmp_path / "log"), Collect("lag")
    write(spark, path, [1, 2])
    write(spark, path, [3], at=datetime.now(timezone.utc))
    run(spark, Spec(path, MemoryCursors(), consumer, StreamOptions(timedelta(hours=1), to_head=True)), str(tmp_path / "cp"))
    assert consumer.seen == [1, 2]


def test_bootstrap_and_types(spark, tmp_path):
    path = str(tmp_path / "log")
    write(spark, path, [1, 2])
    fresh = Collect("fresh")
    run(spark, Spec(path, MemoryCursors(), fresh, TO_HEAD).bootstrapped(), str(tmp_path / "a"))
    assert fresh.seen == []
    known = Collect("known", types=[7])
    cursors = MemoryCursors(known=1)
    run(spark, Spec(path, cursors, known, TO_HEAD).bootstrapped(), str(tmp_path / "b"))
    # A skipped event moves the cursor.
    assert known.seen == [] and cursors.get("known") == "2"


def test_failure_keeps_the_cursor(spark, tmp_path):
    path, cursors, calls = str(tmp_path / "log"), MemoryCursors(), []
    write(spark, path, [1, 2])

    def consume(batch, batch_id):
        calls.append(batch.count())
        if len(calls) == 1:
            raise ValueError("once")

    spec = Spec(path, cursors, Consumer("fails", consume), TO_HEAD)
    with pytest.raises(Exception, match="once"):
        run(spark, spec, str(tmp_path / "cp"))
    assert cursors.get("fails") == ""
    run(spark, spec, str(tmp_path / "cp"))
    assert calls == [2, 2] and cursors.get("fails") == "2"


def test_filter_errors_and_recovery(spark, tmp_path):
    from logweir.operators.filters import outcome

    path = str(tmp_path / "log")
    write(spark, path, [1])
    bad = Collect("bad", event_filter=outcome(F.lit(True), F.lit("broken")))
    with pytest.raises(Exception, match="FilterError"):
        run(spark, Spec(path, MemoryCursors(), bad, TO_HEAD), str(tmp_path / "a"))
    calm = Collect("calm", event_filter=outcome(F.lit(True), F.lit("broken")), recover=lambda e: None)
    cursors = MemoryCursors()
    run(spark, Spec(path, cursors, calm, TO_HEAD), str(tmp_path / "b"))
    assert cursors.get("calm") == "1" and calm.counts == {"errors": 1}


def test_limit_bounds_micro_batches(spark, tmp_path):
    path, sizes = str(tmp_path / "log"), []
    write(spark, path, range(1001, 1011))
    consumer = Consumer("small", lambda batch, _: sizes.append(batch.count()))
    run(spark, Spec(path, MemoryCursors(), consumer, TO_HEAD, limit=4), str(tmp_path / "cp"))
    assert sizes == [4, 4, 2]


def test_offsets_come_from_footers(spark, tmp_path):
    """Runs of ids by file; a run ends before the first event that is too young."""
    from logweir.streaming.source import EventLogStreamReader, Intervals

    path, now = str(tmp_path / "log"), datetime.now(timezone.utc)
    write(spark, path, [1, 2, 3, 7])
    write(spark, path, [4, 5])
    write(spark, path, [6], at=now)
    files = Intervals(path)
    assert [r[:2] for r in files.runs(0, None)] == [(1, 3), (4, 5), (6, 6), (7, 7)]
    assert files.runs(5, None)[0][:2] == (6, 6)
    end = lambda **options: EventLogStreamReader({"path": path, **options}).latestOffset()["after"]
    assert end() == 7 and end(lagMicros="3600000000") == 5 and end(limit="2") == 2 and end(after="7") == 7
    write(spark, path, [9])
    assert end() == 7 and end(gaps="skip") == 9
    reader = EventLogStreamReader({"path": path, "rangeIds": "3"})
    assert [(p.start, p.end) for p in reader.partitions({"after": 0}, {"after": 7})] == [(0, 3), (3, 6), (6, 7)]


def test_a_drain_looks_once(spark, tmp_path):
    """Batches are cut from one look, and a task has the files of its range alone."""
    from logweir.sources.stored import StoredLog
    from logweir.streaming.source import EventLogStreamReader

    def drained(**options):
        reader, start, ends, files = EventLogStreamReader({"limit": "4", **options}), {"after": 0}, [], []
        while (end := reader.latestOffset()) != start:
            files.append([len(p.files) for p in reader.partitions(start, end)])
            ends.append(end["after"])
            start = end
        return reader, ends, files

    path = str(tmp_path / "plain")
    for k in range(5):
        write(spark, path, range(4 * k + 1, 4 * k + 5))
    reader, ends, files = drained(path=path)
    # One look finds the batches, the next that there is no more.
    assert ends == [4, 8, 12, 16, 20] and files == [[1]] * 5 and reader.files.listed == 2
    stored = StoredLog(spark, str(tmp_path / "stored"))
    for k in range(5):
        stored.append(spark.createDataFrame([(n, "k", 1) for n in range(4)], "seq long, foreign_id string, type int").coalesce(1))
    reader, ends, files = drained(path=stored.path)
    assert ends == [4, 8, 12, 16, 20] and files == [[1]] * 5 and (reader.files.listed, reader.files.opened) == (0, 0)
    rows = [r for p in reader.partitions({"after": 4}, {"after": 12}) for b in reader.read(p) for r in b.column(0).to_pylist()]
    assert rows == list(range(5, 13))


def test_ids_that_do_not_rise_fail(spark, tmp_path):
    """An id in two files, or twice in one."""
    from logweir.streaming.source import EventLogStreamReader

    path = str(tmp_path / "log")
    write(spark, path, [1, 2, 3])
    write(spark, path, [3, 4])
    with pytest.raises(errors.NotIncreasing):
        EventLogStreamReader({"path": path}).latestOffset()
    twice = str(tmp_path / "twice")
    write(spark, twice, [1, 2, 2, 3])
    with pytest.raises(Exception, match="twice|increas"):
        run(spark, Spec(twice, MemoryCursors(), Consumer("c", lambda b, _: b.count()), TO_HEAD), str(tmp_path / "cp"))


def test_acknowledged_part_of_a_batch(spark, tmp_path):
    """What was not acknowledged comes again, also on the same checkpoint folder."""
    from logweir.streaming import patterns

    path, cursors, seen = str(tmp_path / "log"), BufferedCursors(), []
    write(spark, path, range(1, 11))

    def consume(batch, ack):
        seen.append([r["id"] for r in batch.collect()])
        if len(seen) == 1:
            ack(6)

    spec = Spec(path, cursors, patterns.acknowledging("ack", consume, cursors), TO_HEAD)
    run(spark, spec, str(tmp_path / "cp"))
    write(spark, path, range(11, 13))
    run(spark, spec, str(tmp_path / "cp"))
    assert seen == [list(range(1, 11)), list(range(7, 13))]


def test_open_batch_comes_again(spark, tmp_path):
    from logweir.streaming import patterns

    path, cursors, seen = str(tmp_path / "log"), BufferedCursors(), []
    write(spark, path, range(1, 11))
    for _ in range(2):
        consumer = patterns.BatchConsumer("b", lambda b: seen.append([r["id"] for r in b.collect()]), cursors=cursors, length=4)
        run(spark, Spec(path, cursors, consumer, TO_HEAD), str(tmp_path / "cp"))
        write(spark, path, range(11, 20))
    assert seen == [[1, 2, 3, 4], [5, 6, 7, 8], [9, 10, 11, 12], [13, 14, 15, 16]] and cursors.get("b") == "16"


def test_notifier_stop_and_metrics(spark, tmp_path):
    import threading

    from logweir.streaming.metrics import Metrics
    from logweir.streaming.notify import Notifier

    path, notifier, metrics, stops = str(tmp_path / "log"), Notifier(), Metrics(), []
    write(spark, path, [1, 2])
    consumer = Collect("woken", types=[1], stop=lambda: stops.append(1))
    take, seen = consumer.take, threading.Event()

    def taken(batch, batch_id):
        take(batch, batch_id)
        if len(consumer.seen) == 2:
            write(spark, path, [3])
            write(spark, path, [4], kind=2)
            notifier.notify()

    consumer.consume = taken
    spec = Spec(path, MemoryCursors(), consumer, metrics=metrics)
    run(spark, spec, str(tmp_path / "cp"), notifier=notifier, backoff=300, timeout=25)
    assert consumer.seen == [1, 2, 3] and spec.cursors.get("woken") == "4" and stops == [1] and not seen.is_set()
    assert metrics.value("consumer_skipped", "woken") == 1 and metrics.value("cursor_sets", "woken") == 2
    assert metrics.value("consumer_lag_seconds", "woken") is None and metrics.value("consumer_lag_alert", "woken") == 1
    assert metrics.value("consumer_active", "woken") == 1
    counts = {b: v for n, label, b, v in metrics.samples() if n == "consumer_age_seconds"}
    assert counts["count"] == 4 and counts["0.1"] == 0 and 'consumer_skipped{label="woken"} 1' in metrics.text()


def test_run_forever():
    ends, waits, stops = iter([errors.Stopped(), ValueError()]), [], []

    def start():
        raise next(ends)

    run_forever(start, lambda: stops.append(1), sleep=waits.append, rounds=2)
    assert waits == [0.1, 60.0] and len(stops) == 2


def test_a_task_decodes_a_few_rows_at_once(tmp_path):
    """A range in a large row group: what lies beside it is let go while it is read."""
    import pyarrow as pa
    import pyarrow.parquet as pq

    from logweir.streaming.source import EventLogStreamReader

    n = 2_000_000
    text = pa.array([b"x" * 100]).take(pa.array([0] * n))
    pq.write_table(pa.table({"id": pa.array(range(1, n + 1)), "metadata": text}), f"{tmp_path}/a.parquet", row_group_size=n)
    del text
    reader = EventLogStreamReader({"path": str(tmp_path), "rangeIds": "50000"})
    part = reader.partitions({"after": 0}, reader.latestOffset())[20]
    pool = pa.proxy_memory_pool(pa.default_memory_pool())
    kept = pa.default_memory_pool()
    pa.set_memory_pool(pool)
    try:
        ids = [i for b in reader.read(part) for i in b.column(0).to_pylist()]
    finally:
        pa.set_memory_pool(kept)
    assert ids == list(range(part.start + 1, part.end + 1)) and len(ids) == 50_000
    assert pool.max_memory() < 60_000_000
