"""Stored logs, cursors and errors; holes filled in the log; the head cache; blob following."""

import os
import threading
import time
from datetime import timedelta
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from logweir import commits, errors
from logweir.functions.traces import in_trace
from logweir.operators import gaps, log
from logweir.operators.cursors import MemoryCursors, ReadThroughCursors, TableCursors
from logweir.schema import CursorColumns, ErrorColumns, EventColumns
from logweir.sources import blobs
from logweir.options import StreamOptions
from logweir.sources.cache import TailCache
from logweir.sources.stored import ErrorStore, StoredLog, append_parquet, fill_gaps
from logweir.storage import Versions
from logweir.streaming import patterns
from logweir.streaming.metrics import Metrics
from logweir.streaming.notify import Notifier
from logweir.streaming.run import Consumer, Spec, run


def rows(spark, *keys, kind=1):
    return spark.createDataFrame([(n, k, kind) for n, k in enumerate(keys)], "seq long, foreign_id string, type int")


def test_versions(spark, tmp_path):
    records = Versions(spark, str(tmp_path))
    assert records.last("a/b") == (0, None) and records.names() == []
    assert records.create("a/b", 1, b"x") and not records.create("a/b", 1, b"y")
    assert records.last("a/b") == (1, b"x") and records.names() == ["a/b"]
    for n in range(2, 31):
        assert records.create("a/b", n, b"%d" % n)
    # A writer that slept finds its number free again, and has lost all the same.
    assert not records.create("a/b", 2, b"late") and records.last("a/b") == (30, b"30")
    assert not (tmp_path / "a%2Fb" / f"{2:020d}").exists()


@pytest.mark.parametrize("way", [commits._link, commits._rename])
def test_create_once(spark, tmp_path, way):
    """Of many writers of one file, one wins, and its bytes are whole."""
    url, won = f"file://{tmp_path}/deep/er/1.json", []
    Path(tmp_path, "deep/er").mkdir(parents=True)
    if way is commits._link:
        threads = [threading.Thread(target=lambda k=k: way(spark, url, b"%d" % k * 1000) and won.append(k)) for k in range(8)]
        [t.start() for t in threads]
        [t.join() for t in threads]
    else:
        won += [k for k in range(3) if way(spark, url, b"%d" % k * 1000)]
    assert len(won) == 1 and Path(tmp_path, "deep/er/1.json").read_bytes() == b"%d" % won[0] * 1000
    assert [f for f in os.listdir(tmp_path / "deep/er") if not f.endswith(".crc")] == ["1.json"]
    with pytest.raises(ValueError, match="ftp"):
        commits.create_once(spark, "ftp://host/x", b"")


def test_commit_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(commits, "CHECKPOINT", 4)
    logs = [commits.CommitLog(spark, f"{tmp_path}/log") for _ in range(2)]
    for k in range(9):
        logs[k % 2].commit(lambda now, k=k: {"a": {"reserve": {f"t{k}": [now.table("a").upto + 1, now.table("a").upto + 2]}}})
    logs[0].commit(lambda now: {"a": {"end": ["t0", "t1"], "add": [["f", 1, 4, 4, None]]}, "b": {"add": [["g", 7, 9, 2, 5]]}})
    with pytest.raises(errors.ReservationLost):
        logs[1].commit(lambda now: {"a": {"end": ["t1"], "add": [["h", 3, 4, 2, None]]}})
    assert logs[1].commit(lambda now: None).version == 10
    fresh = commits.CommitLog(spark, f"{tmp_path}/log").snapshot()
    assert fresh == logs[0].snapshot() == logs[1].snapshot()
    assert fresh.table("a").upto == 18 and sorted(fresh.table("a").open) == [f"t{k}" for k in range(2, 9)] and fresh.table("a").files[0].solid
    assert fresh.table("b").upto == 9 and not fresh.table("b").files[0].solid
    # From the checkpoint alone and what follows, as well as from all records.
    for n in range(1, 9):
        os.remove(tmp_path / "log" / f"{n:020d}.json")
    assert commits.CommitLog(spark, f"{tmp_path}/log").snapshot() == fresh


def test_cursors_outlive_their_store(spark, tmp_path):
    url = str(tmp_path / "cursors")
    told = []
    store = TableCursors(spark, url, buffered=False, on_set=told.append, columns=CursorColumns(consumer="who"))
    for c in ("1", "2"):
        store.set("one", c)
    store.set("two/2", "3")
    again = store.clone()
    assert (again.get("one"), again.get("two/2"), again.get("none")) == ("2", "3", "") and told == ["one", "one", "two/2"]
    with pytest.raises(errors.CursorNotIncreasing):
        again.set("one", "2")
    with pytest.raises(errors.InvalidId):
        again.set("one", "x")
    assert {(r["who"], r["last_event_id"]) for r in again.table().collect()} == {("one", "2"), ("two/2", "3")}
    assert TableCursors(spark, str(tmp_path / "none")).table().count() == 0
    through = ReadThroughCursors(TableCursors(spark, str(tmp_path / "new"), buffered=False), store)
    assert through.get("one") == "2" and through.primary.get("one") == "2"


def test_cursors_flush_in_time(spark, tmp_path):
    import time

    store = TableCursors(spark, str(tmp_path), period=0.2)
    store.set("a", "5")
    assert store.get("a") == ""
    end = time.monotonic() + 20
    while store.get("a") != "5" and time.monotonic() < end:
        time.sleep(0.05)
    assert store.get("a") == "5"
    store.set("a", "4")
    time.sleep(1.5)
    with pytest.raises(errors.CursorNotIncreasing):
        store.flush()
    text = TableCursors(spark, str(tmp_path / "text"), strings=True, buffered=False)
    text.set("a", "abc")
    text.set("a", "abcd")
    with pytest.raises(errors.CursorNotIncreasing):
        text.set("a", "aaa")


def test_two_writers_of_one_cursor(spark, tmp_path):
    stores = [TableCursors(spark, str(tmp_path), buffered=False) for _ in range(2)]
    refused = []

    def write(store, start):
        for c in range(start, 20, 2):
            try:
                store.set("a", str(c))
            except errors.CursorNotIncreasing:
                refused.append(c)

    threads = [threading.Thread(target=write, args=(s, n + 1)) for n, s in enumerate(stores)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert int(stores[0].get("a")) in (18, 19)


def test_append(spark, tmp_path):
    woken = Notifier()
    stored = StoredLog(spark, str(tmp_path / "log"), notifier=woken)
    assert stored.events().count() == 0
    wait = woken.register()
    notify = stored.append(rows(spark, "a", "b", "c"))
    assert not wait.is_set()
    notify()
    assert wait.is_set()
    trace, span = "0" * 31 + "9", "0" * 15 + "2"
    with in_trace(trace, span):
        stored.insert("d", 2, b"meta")
    with in_trace("0" * 32, span):
        stored.insert("e", 2)
    got = stored.events().orderBy("id").collect()
    assert [(r["id"], r["foreign_id"], r["type"]) for r in got] == [(1, "a", 1), (2, "b", 1), (3, "c", 1), (4, "d", 2), (5, "e", 2)]
    assert bytes(got[3]["metadata"]) == b"meta" and bytes(got[3]["trace"]) == b"\x0a\x20" + trace.encode() + b"\x12\x10" + span.encode() and got[4]["trace"] is None
    with pytest.raises(Exception, match="no-op"):
        stored.insert("0", 0)
    assert stored.events().count() == 5 and [r["id"] for r in stored.log().page(spark, 3).collect()] == [4, 5]
    bare = StoredLog(spark, str(tmp_path / "bare"), EventColumns(id="custom_id", type="custom_type"))
    with pytest.raises(errors.InvalidEvent):
        bare.insert("a", 1, b"meta")
    bare.insert("a", 1)
    assert spark.read.option("recursiveFileLookup", True).parquet(bare.path).columns == ["custom_id", "custom_type", "foreign_id", "timestamp"] and bare.events().first()["id"] == 1


def test_own_inserter_and_parallel_appends(spark, tmp_path):
    counted = []
    stored = StoredLog(spark, str(tmp_path / "log"))
    own = stored.clone(inserter=lambda frame, path: counted.append(frame.count()))
    own.append(rows(spark, "a", "b"))
    assert counted == [2] and not stored.commits.snapshot().table("events").open
    threads = [threading.Thread(target=stored.clone().append, args=(rows(spark, "x", "y", "z"),)) for _ in range(3)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    # The ids of the events that were never written stay open.
    assert sorted(r["id"] for r in stored.events().collect()) == list(range(3, 12))
    assert [r["id"] for r in stored.events(8).orderBy("id").collect()] == [9, 10, 11]


class Paused:
    """A writer that stops before, or after, its files are written, until it is told to go on."""

    def __init__(self, stored, *keys, wrote=True):
        self.at, self.go, self.failure = threading.Event(), threading.Event(), None

        def inserter(frame, path):
            if wrote:
                append_parquet(frame, path)
            first = not self.at.is_set()
            self.at.set()
            assert self.go.wait(60)
            if not wrote or not first:
                frame.write.mode("overwrite").parquet(path)

        def work():
            try:
                stored.clone(inserter=inserter).append(rows(stored.spark, *keys))
            except Exception as e:
                self.failure = e

        self.thread = threading.Thread(target=work)
        self.thread.start()
        assert self.at.wait(60)

    def end(self):
        self.go.set()
        self.thread.join()


def _ids(stored):
    return [(r["id"], r["foreign_id"]) for r in stored.events().orderBy("id").collect()]


@pytest.mark.parametrize("wrote", [True, False])
def test_ids_are_given_once(spark, tmp_path, wrote):
    """A writer that was overtaken between its reservation and its files keeps its ids."""
    stored = StoredLog(spark, str(tmp_path / "log"))
    stored.append(rows(spark, "a", "b"))
    slow = Paused(stored, "c", "d", wrote=wrote)
    stored.append(rows(spark, "e", "f"))
    assert _ids(stored) == [(1, "a"), (2, "b"), (5, "e"), (6, "f")]
    # Its reservation is alive: the filler waits, as it would for an open transaction.
    assert fill_gaps(stored).poll() and len(_ids(stored)) == 4
    slow.end()
    assert slow.failure is None
    assert _ids(stored) == [(1, "a"), (2, "b"), (3, "c"), (4, "d"), (5, "e"), (6, "f")] and not fill_gaps(stored).poll()


def test_a_late_writer_cannot_write_over_the_filler(spark, tmp_path):
    stored = StoredLog(spark, str(tmp_path / "log"), lease=timedelta(seconds=1000))
    stored.append(rows(spark, "a", "b"))
    late = Paused(stored, "c", "d")
    stored.append(rows(spark, "e"))
    filled = []
    assert fill_gaps(stored, lease=timedelta(seconds=-1), counter=filled.append).poll() and filled == [2]
    assert _ids(stored) == [(1, "a"), (2, "b"), (3, "0"), (4, "0"), (5, "e")]
    late.end()
    # Its events come behind, with ids of their own.
    assert late.failure is None
    assert _ids(stored) == [(1, "a"), (2, "b"), (3, "0"), (4, "0"), (5, "e"), (6, "c"), (7, "d")]


def test_a_filler_that_is_overtaken_adds_nothing(spark, tmp_path):
    stored = StoredLog(spark, str(tmp_path / "log"))
    stored.append(rows(spark, "a"))
    late = Paused(stored, "b")
    stored.append(rows(spark, "c"))
    filler = fill_gaps(stored, lease=timedelta(seconds=-1))

    def inserter(frame, path):
        append_parquet(frame, path)
        late.end()

    filler.handlers[0].target = stored.clone(inserter=inserter)
    assert filler.poll() and _ids(stored) == [(1, "a"), (2, "b"), (3, "c")] and not filler.poll()


def test_two_fillers(spark, tmp_path):
    stored = StoredLog(spark, str(tmp_path / "log"))
    stored.append(rows(spark, "a"))
    stored.reserve(3)
    stored.append(rows(spark, "b"))
    filled = []
    listeners = [fill_gaps(stored.clone(), lease=timedelta(seconds=-1), counter=filled.append) for _ in range(2)]
    threads = [threading.Thread(target=x.poll) for x in listeners]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert _ids(stored) == [(1, "a"), (2, "0"), (3, "0"), (4, "0"), (5, "b")] and filled == [3]


def test_a_long_writer_renews(spark, tmp_path):
    stored = StoredLog(spark, str(tmp_path / "log"), lease=timedelta(seconds=1.5))
    stored.append(rows(spark, "a"))
    slow = Paused(stored, "b")
    stored.append(rows(spark, "c"))
    time.sleep(3)
    assert fill_gaps(stored).poll() and len(_ids(stored)) == 2
    slow.end()
    assert _ids(stored) == [(1, "a"), (2, "b"), (3, "c")]


def test_a_failed_writer_leaves_a_hole_at_once(spark, tmp_path):
    stored = StoredLog(spark, str(tmp_path / "log"))
    stored.append(rows(spark, "a"))

    def fail(frame, path):
        append_parquet(frame, path)
        raise OSError("disk")

    with pytest.raises(OSError):
        stored.clone(inserter=fail).append(rows(spark, "b"))
    stored.append(rows(spark, "c"))
    assert _ids(stored) == [(1, "a"), (3, "c")] and fill_gaps(stored).poll()
    assert _ids(stored) == [(1, "a"), (2, "0"), (3, "c")]


def test_files_without_a_commit_log_are_taken_in(spark, tmp_path):
    path = f"{tmp_path}/a log"
    old = spark.createDataFrame([(i, 1, f"k{i}") for i in (1, 2, 5)], "id long, type int, foreign_id string").withColumns({"timestamp": F.lit("2024-01-01").cast("timestamp"), "metadata": F.lit(None).cast("binary"), "trace": F.lit(None).cast("binary")})
    old.repartition(2).write.parquet(path)
    stored = StoredLog(spark, path)
    assert stored.events().count() == 3
    stored.insert("new", 1)
    assert _ids(stored) == [(1, "k1"), (2, "k2"), (5, "k5"), (6, "new")]
    assert fill_gaps(stored, grace=F.expr("INTERVAL 100 YEARS")).poll() and len(_ids(stored)) == 4
    assert fill_gaps(stored).poll() and [i for i, _ in _ids(stored)] == [1, 2, 3, 4, 5, 6]


def test_holes_are_filled_in_the_log(spark, tmp_path):
    stored = StoredLog(spark, str(tmp_path / "log"))
    stored.append(rows(spark, "a"), now=F.lit("2024-01-01").cast("timestamp"))
    stored.release(stored.reserve(2)[0])
    stored.append(rows(spark, "b"), now=F.lit("2024-01-02").cast("timestamp"))
    stored.reserve(1)
    stored.append(rows(spark, "c"))
    assert [tuple(r) for r in gaps.gaps(stored.events()).orderBy("prev").collect()] == [(1, 4), (4, 6)]
    filled, found, listens = [], [], []
    listener = fill_gaps(stored, period=0.1, counter=filled.append, found=found.append)
    assert listener.poll() and filled == [2] and found == [2]
    got = {r["id"]: (r["foreign_id"], r["type"], r["timestamp"].day) for r in stored.events().collect()}
    assert got[2] == got[3] == ("0", 0, 2) and 5 not in got
    # Again changes nothing while the last hole's writer may be alive.
    assert listener.poll() and stored.events().count() == 5 and found == [2, 1]
    late = fill_gaps(stored, period=0.05, lease=timedelta(seconds=-1), listening=listens.append)
    seen = threading.Event()
    late.listen(lambda holes: seen.set())
    late.start()
    assert seen.wait(30)
    late.stop()
    assert late.failure is None and gaps.gaps(stored.events()).isEmpty() and not late.poll() and listens == [True, False]
    never = fill_gaps(stored)
    never.stop()


def _calls(spark, *ids, name="m"):
    return spark.createDataFrame([(n, "c", i, f"{name}{n}") for n, i in enumerate(ids)], "seq long, consumer string, event_id long, error_msg string").withColumn("at", F.current_timestamp())


def test_two_recorders_at_once(spark, tmp_path):
    """Both merge against the same errors; the second to commit merges anew."""
    both = threading.Barrier(2)
    met = threading.local()

    def inserter(frame, path):
        append_parquet(frame, path)
        if not getattr(met, "done", False):
            met.done = True
            both.wait(60)

    stores = [ErrorStore(spark, f"{tmp_path}/errors", inserter=inserter) for _ in range(2)]
    threads = [threading.Thread(target=s.record, args=(_calls(spark, 7, name=f"m{k}"),)) for k, s in enumerate(stores)]
    [t.start() for t in threads]
    [t.join() for t in threads]
    assert [(r["id"], r["consumer"], r["event_id"]) for r in stores[0].errors().collect()] == [(1, "c", "7")]
    assert sorted((r["id"], r["foreign_id"]) for r in stores[0].events.events().collect()) == [(1, "1"), (2, "1")]


@pytest.mark.parametrize("where", ["inserter", "event_inserter"])
def test_a_crash_leaves_neither_rows_nor_events(spark, tmp_path, where):
    def fail(frame, path):
        append_parquet(frame, path)
        raise OSError("crash")

    store = ErrorStore(spark, f"{tmp_path}/errors", **{where: fail})
    with pytest.raises(OSError):
        store.record(_calls(spark, 7))
    whole = ErrorStore(spark, f"{tmp_path}/errors")
    assert whole.errors().count() == 0 and whole.events.events().count() == 0
    whole.record(_calls(spark, 7))
    assert whole.errors().count() == 1 and whole.events.events().count() == 1


def test_error_store(spark, tmp_path):
    counted, woken = [], Notifier()
    store = ErrorStore(spark, str(tmp_path / "errors"), ErrorColumns(error_msg="msg"), counter=lambda *a: counted.append(a), notifier=woken)
    calls = lambda *ids: spark.createDataFrame([(n, "c", i, f"m{n}") for n, i in enumerate(ids)], "seq long, consumer string, event_id long, error_msg string").withColumn("at", F.current_timestamp())
    wait = woken.register()
    store.record(calls(7, 8, 7))
    store.record(calls(8, 9))
    store.record(calls())
    got = store.errors().orderBy("id").collect()
    assert [(r["id"], r["consumer"], r["event_id"], r["error_msg"], r["error_status"]) for r in got] == [(1, "c", "7", "m0", 1), (2, "c", "8", "m1", 1), (3, "c", "9", "m1", 1)]
    events = store.events.events().orderBy("id").collect()
    assert [(r["id"], r["foreign_id"], r["type"], bytes(r["metadata"])) for r in events] == [(n, f, 1, b"c") for n, f in enumerate("12123", 1)]
    assert wait.is_set() and counted == [("c", 3), ("c", 2)] and "msg" in spark.read.option("recursiveFileLookup", True).parquet(store.path).columns
    quiet = ErrorStore(spark, str(tmp_path / "quiet"), record_only=True)
    quiet.record(calls(1))
    assert quiet.errors().count() == 1 and quiet.events.events().count() == 0


def test_dead_letters_go_to_the_store(spark, tmp_path):
    stored = StoredLog(spark, str(tmp_path / "log"))
    stored.append(rows(spark, "a", "b", "c"))
    store = ErrorStore(spark, str(tmp_path / "errors"))

    def handle(row):
        if row["id"] == 2:
            raise ValueError("two")

    patterns.dead_letter("d", handle, store.record).consume(stored.events(), 0)
    assert [(r["consumer"], r["event_id"], r["error_msg"]) for r in store.errors().collect()] == [("d", "2", "ValueError: two")]


def test_tail_cache(spark):
    loads = []

    def events(after):
        loads.append(after)
        return spark.range(after + 1, 31).select("id")

    cache = TailCache(events, size=8)
    span = lambda a, b: sorted(r["id"] for r in cache.between(a, b).collect())
    assert span(0, 5) == [1, 2, 3, 4, 5] and span(2, 5) == [3, 4, 5] and (cache.hits, cache.misses, loads) == (1, 1, [0])
    # Goes on where it ends, and is trimmed at its start.
    assert span(4, 11) == list(range(5, 12)) and loads == [0, 5] and [(p.after, p.upto) for p in cache.pieces] == [(0, 5), (5, 11)]
    assert span(11, 14) == [12, 13, 14] and [(p.after, p.upto) for p in cache.pieces] == [(5, 11), (11, 14)] and span(6, 12) == list(range(7, 13))
    # Older ranges are not kept; beyond its end it starts anew.
    assert span(1, 3) == [2, 3] and len(cache.pieces) == 2
    assert span(20, 22) == [21, 22] and [(p.after, p.upto) for p in cache.pieces] == [(20, 22)] and (cache.hits, cache.misses) == (2, 5)
    cache.close()
    off = TailCache(events, enabled=False)
    assert off.between(0, 3).count() == 3 and (off.hits, off.misses) == (0, 0)


def test_two_readers_near_the_head_cost_one_load(spark, tmp_path):
    stored, metrics = StoredLog(spark, str(tmp_path / "log")), Metrics()
    stored.append(rows(spark, *"abcdefghij"))
    loads = []

    def events(after):
        loads.append(after)
        return stored.events(after)

    cache, seen = TailCache(events, metrics=metrics, label="log"), {}
    for name in ("first", "second"):
        consumer = Consumer(name, lambda batch, _, name=name: seen.setdefault(name, []).extend(r["foreign_id"] for r in batch.collect()))
        run(spark, Spec(stored.path, MemoryCursors(), consumer, StreamOptions(to_head=True), cache=cache, metrics=metrics), str(tmp_path / "cp"))
    assert seen == {"first": list("abcdefghij"), "second": list("abcdefghij")}
    assert loads == [0] and metrics.value("cache_hits", "log") == 1 and metrics.value("cache_misses", "log") == 1
    cache.close()


def test_one_live_run_shows_its_metrics(spark, tmp_path):
    """Whatever applies to a log, its filler and its consumers is told by the library itself."""
    metrics, stored = Metrics(), StoredLog(spark, str(tmp_path / "log"))
    stored.append(rows(spark, *"abcd"))
    stored.release(stored.reserve(2)[0])
    stored.append(rows(spark, *"efgh"))
    filler = fill_gaps(stored, metrics=metrics, period=0.05)
    filled = threading.Event()
    filler.listen(lambda _: filled.set())
    filler.start()
    assert filled.wait(60) and metrics.value("gap_listeners", stored.path) == 1
    filler.stop()
    assert metrics.value("gap_listeners", stored.path) == 0 and metrics.value("gaps_filled", stored.path) == 2 and metrics.value("gaps_detected", stored.path) >= 1
    filler.poll()
    assert metrics.value("blocking_gaps", stored.path) == 0

    def handle(row):
        if row["foreign_id"] == "c":
            raise ValueError("c")

    cursors = MemoryCursors()
    dead = patterns.dead_letter("dead", handle, lambda frame: frame.count())
    held = patterns.BatchConsumer("batch", lambda b: b.count(), cursors=cursors, length=3)
    cache = TailCache(stored.events, metrics=metrics, label="log")
    for consumer, options in ((dead, {"cache": cache}), (held, {})):
        run(spark, Spec(stored.path, cursors, consumer, StreamOptions(to_head=True), metrics=metrics, **options), str(tmp_path / "cp"))
    value = metrics.value
    assert value("consumer_dead_letters", "dead") == 1 and value("cache_misses", "log") == 1 and value("batch_buffered", "batch") == 2
    assert value("cursor_sets", "dead") == 1 and value("polls", "dead") >= 1 and value("decoded_rows", "batch") == 10
    names = {n for n, label, bound, v in metrics.samples()}
    assert {"load_seconds", "decode_seconds", "consumer_age_seconds", "consumer_latency_seconds", "consumer_active", "consumer_lag_alert"} <= names
    cache.close()


def test_blobs_are_followed(spark, tmp_path):
    folder = tmp_path / "blobs"
    bucket = blobs.Bucket(f"file://{folder}")
    with pytest.raises(blobs.MissingBucket):
        bucket.stream(spark)
    folder.mkdir()
    (folder / "a").write_text('{"id":1}{"id":2}')
    cursors, seen, waits = MemoryCursors(), [], []

    def sleep(seconds):
        waits.append(seconds)
        (folder / "b").write_text('{"id":3}')

    bucket.follow(spark, lambda frame: seen.append([bytes(r["metadata"]).decode() for r in frame.collect()]), cursors, "c", sleep=sleep, rounds=2)
    assert seen == [['{"id":1}', '{"id":2}'], ['{"id":3}']] and cursors.get("c") == "b|eof" and waits == [60.0]
    bucket.close()
    with pytest.raises(errors.Stopped):
        bucket.follow(spark, seen.append, cursors, "c", rounds=1)


def test_order_across_partitions(spark):
    frame = lambda *parts: spark.sparkContext.parallelize(parts, len(parts)).flatMap(lambda p: [(i, "x") for i in p]).toDF("id long, v string")
    assert log.checked_increasing(frame([1, 2], [], [5, 9])).count() == 4
    for bad in (frame([1, 4], [3, 5]), frame([1, 1], [2]), frame([5], [1, 2])):
        with pytest.raises(Exception, match="do not increase"):
            log.checked_increasing(bad).collect()
