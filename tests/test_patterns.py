"""Live consumption patterns."""

import time
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.sql import functions as F

from logweir import errors
from logweir.operators import shards
from logweir.operators.cursors import BufferedCursors, MemoryCursors
from logweir.operators.filters import outcome
from logweir.options import StreamOptions
from logweir.schema import EVENT
from logweir.sources.memory import MemoryLog
from logweir.sources.stored import StoredLog
from logweir.streaming import patterns, serving
from logweir.streaming.run import Consumer, Spec, run

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)
TO_HEAD = StreamOptions(to_head=True)


@pytest.fixture
def path(spark, tmp_path):
    rows = [(i, 1, str(i % 3), T0 + timedelta(seconds=i), None, None) for i in range(1, 21)]
    spark.createDataFrame(rows, EVENT).coalesce(1).write.parquet(str(tmp_path / "log"))
    return str(tmp_path / "log")


def test_acknowledging(spark, path, tmp_path):
    cursors = BufferedCursors()
    consumer = patterns.acknowledging("ack", lambda batch, ack: [ack(r["id"]) for r in batch.collect() if r["id"] in (2, 4, 6)], cursors)
    run(spark, Spec(path, cursors, consumer, TO_HEAD), str(tmp_path / "cp"))
    assert cursors.get("ack") == "6"


def ids_of(seen):
    return lambda batch: seen.append([r["id"] for r in batch.collect()])


@pytest.mark.parametrize("length, sizes, cursor", [(4, [4] * 5, "20"), (15, [15], "15"), (40, [], "")])
def test_batches_by_length(spark, path, tmp_path, length, sizes, cursor):
    cursors, seen = BufferedCursors(), []
    consumer = patterns.BatchConsumer("b", lambda b: seen.append(b.count()), cursors=cursors, length=length)
    run(spark, Spec(path, cursors, consumer, TO_HEAD), str(tmp_path / "cp"))
    assert seen == sizes and cursors.get("b") == cursor


def test_batches_span_micro_batches(spark, path, tmp_path):
    cursors, seen, held = MemoryCursors(), [], []
    consumer = patterns.BatchConsumer("b", ids_of(seen), cursors=cursors, period=timedelta(days=10_000), length=6, buffered=held.append)
    run(spark, Spec(path, cursors, consumer, TO_HEAD, limit=4), str(tmp_path / "cp"))
    assert seen == [list(range(1, 7)), list(range(7, 13)), list(range(13, 19))] and cursors.get("b") == "18" and held == [4, 2, 0, 4, 2]
    seen.clear()
    consumer = patterns.BatchConsumer("p", ids_of(seen), cursors=cursors, period=timedelta(seconds=5))
    run(spark, Spec(path, cursors, consumer, TO_HEAD), str(tmp_path / "cp"))
    assert seen[:3] == [[1, 2, 3, 4, 5], [6, 7, 8, 9, 10], [11, 12, 13, 14, 15]] and cursors.get("p") in ("15", "20")
    with pytest.raises(errors.InvalidBatchConfig):
        patterns.BatchConsumer("b", None, cursors=cursors)


def test_batches_together(spark, path, tmp_path):
    cursors, seen = MemoryCursors(), []
    consumer = patterns.BatchConsumer("b", lambda rows: seen.append([(r["batch"], r["id"]) for r in rows.collect()]), cursors=cursors, length=8, together=True)
    run(spark, Spec(path, cursors, consumer, TO_HEAD), str(tmp_path / "cp"))
    assert seen == [[(1 if i < 9 else 9, i) for i in range(1, 17)]] and cursors.get("b") == "16"


@pytest.fixture
def mixed(spark, tmp_path):
    """Types 1 to 3 in turn, every tenth event a placeholder."""
    rows = [(i, *((0, "0") if i % 10 == 0 else (i % 3 + 1, f"k{i}")), T0 + timedelta(seconds=i), bytes([i]), None) for i in range(1, 61)]
    spark.createDataFrame(rows, EVENT).repartition(3).write.parquet(str(tmp_path / "mixed"))
    return str(tmp_path / "mixed"), [(r[0], r[1], r[2]) for r in rows]


def chunks(ids, n):
    return [ids[k : k + n] for k in range(0, len(ids) - n + 1, n)]


@pytest.mark.parametrize("limit", [None, 7])
def test_batches_hold_what_their_filters_pass(spark, mixed, tmp_path, limit):
    path, rows = mixed
    cursors, seen = MemoryCursors(), []
    even = outcome(F.col("id") % 2 == 0)
    for name, options, keep in [
        ("types", {"types": [1]}, lambda i, t, f: t == 1),
        ("filter", {"event_filter": even}, lambda i, t, f: i % 2 == 0 and f != "0"),
        ("both", {"types": [1, 2], "event_filter": even}, lambda i, t, f: t in (1, 2) and i % 2 == 0),
        ("none", {}, lambda i, t, f: f != "0"),
    ]:
        seen.clear()
        run(spark, Spec(path, cursors, patterns.BatchConsumer(name, ids_of(seen), cursors=cursors, length=4, **options), TO_HEAD, limit=limit), str(tmp_path / "cp"))
        want = chunks([i for i, t, f in rows if keep(i, t, f)], 4)
        assert seen == want and cursors.get(name) == str(want[-1][-1])
    seen.clear()
    run(spark, Spec(path, cursors, patterns.BatchConsumer("noops", ids_of(seen), cursors=cursors, length=4), TO_HEAD, include_noops=True, limit=limit), str(tmp_path / "cp"))
    assert seen == chunks(list(range(1, 61)), 4)
    bad = outcome(F.col("id") > 0, F.when(F.col("id") == 5, "bad"))
    with pytest.raises(Exception, match="FilterError"):
        run(spark, Spec(path, cursors, patterns.BatchConsumer("bad", ids_of(seen), cursors=cursors, length=4, event_filter=bad), TO_HEAD), str(tmp_path / "cp"))


def test_batches_of_shards(spark, mixed, tmp_path):
    """Each shard has batches of its own events, from one scan."""
    path, rows = mixed
    cursors, seen = MemoryCursors(), {0: [], 1: []}
    base = Spec(path, cursors, Consumer("s", None), TO_HEAD, limit=9)
    spec = patterns.parallel(base, 2, lambda m, name: patterns.BatchConsumer(name, ids_of(seen[m]), cursors=cursors, length=3))
    run(spark, spec, str(tmp_path / "cp"))
    shard = {r["id"]: r["s"] for r in spark.read.parquet(path).select("id", shards.shard(2).alias("s")).collect()}
    for m in (0, 1):
        want = chunks([i for i, t, f in rows if f != "0" and shard[i] == m + 1], 3)
        assert seen[m] == want and cursors.get(f"s_{m + 1}_of_2") == str(want[-1][-1])
    # The one that lags has its events again, alone.
    cursors.set("s_1_of_2", str(seen[0][1][-1]))
    before = [list(s) for s in seen.values()]
    run(spark, spec, str(tmp_path / "cp"))
    assert seen[0] == before[0] + before[0][2:] and seen[1] == before[1]
    wired = patterns.consumer_shards("w", 2)[0].wire(patterns.BatchConsumer("x", ids_of(seen[0]), cursors=cursors, length=3))
    seen[0].clear()
    run(spark, Spec(path, cursors, wired, TO_HEAD), str(tmp_path / "cp"))
    assert seen[0] == before[0] and cursors.get("w_1_of_2") == str(before[0][-1][-1]) and cursors.get("x") == ""


def test_a_failing_batch_comes_again(spark, path, tmp_path):
    cursors, seen = MemoryCursors(), []

    def fail(batch):
        ids = [r["id"] for r in batch.collect()]
        if ids[0] == 5 and not any(s == ids for s in seen):
            seen.append(ids)
            raise ValueError("no")
        seen.append(ids)

    consumer = patterns.BatchConsumer("b", fail, cursors=cursors, length=4)
    with pytest.raises(Exception, match="no"):
        run(spark, Spec(path, cursors, consumer, TO_HEAD), str(tmp_path / "cp"))
    assert seen == [[1, 2, 3, 4], [5, 6, 7, 8]] and cursors.get("b") == "4" and consumer.counts["errors"] == 1
    run(spark, Spec(path, cursors, consumer, TO_HEAD), str(tmp_path / "cp"))
    assert seen[2:] == chunks(list(range(5, 21)), 4) and cursors.get("b") == "20"
    swallowed = patterns.BatchConsumer("r", lambda b: 1 / 0, cursors=cursors, length=4, recover=lambda e: None)
    run(spark, Spec(path, cursors, swallowed, TO_HEAD), str(tmp_path / "cp"))
    assert cursors.get("r") == "" and swallowed.counts["errors"] == 1


def test_batch_timer(spark, tmp_path):
    """A batch closes when its time is over though nothing follows; at once means after a least wait."""
    cursors, seen, held = MemoryCursors(), [], []
    log = StoredLog(spark, str(tmp_path / "log"))
    log.append(spark.createDataFrame([(i, f"k{i}", 1) for i in range(3)], "seq long, foreign_id string, type int"))

    def take(batch):
        seen.append((time.time(), [(r["id"], r["timestamp"]) for r in batch.collect()]))
        if len(seen) == 1:
            log.insert("late", 1)

    consumer = patterns.BatchConsumer("b", take, cursors=cursors, period=timedelta(seconds=12), buffered=held.append)
    run(spark, Spec(log.path, cursors, consumer), str(tmp_path / "cp"), interval="200 milliseconds", timeout=30)
    assert [[i for i, _ in batch] for _, batch in seen[:2]] == [[1, 2, 3], [4]] and cursors.get("b") == "4"
    first = seen[0][1][0][1].timestamp()
    assert seen[0][0] >= first + 12 and held[:2] == [3, 0]
    stored = {r["id"]: r["timestamp"] for r in log.events().collect()}
    assert all(stored[i] == at for _, batch in seen for i, at in batch)
    seen.clear()
    old = patterns.BatchConsumer("old", lambda b: seen.append(b.count()), cursors=cursors, period=timedelta(milliseconds=1))
    run(spark, Spec(log.path, cursors, old), str(tmp_path / "cp"), interval="200 milliseconds", timeout=12)
    assert sum(seen) == 4 and cursors.get("old") == "4"


def failing_on_seven():
    """A closure, so that tasks get it by value."""

    def handle(row):
        if row["id"] == 7:
            raise ValueError("seven")

    return handle


def test_concurrent(spark, path, tmp_path):
    cursors = MemoryCursors()
    with pytest.raises(Exception, match="event 7"):
        run(spark, Spec(path, cursors, patterns.concurrent("c", failing_on_seven(), cursors), TO_HEAD), str(tmp_path / "cp"))
    assert cursors.get("c") == "6"


def waiting_for(folder, failing=(), seconds=60):
    """The first event waits until the last was handled."""

    def handle(row, folder=str(folder), failing=failing, seconds=seconds):
        import os
        import time

        if row["id"] in failing:
            raise ValueError(row["id"])
        open(f"{folder}/{row['id']}", "w").close()
        end = time.monotonic() + seconds
        while row["id"] == 1 and not os.path.exists(f"{folder}/20") and time.monotonic() < end:
            time.sleep(0.05)

    return handle


def test_micro_batches_side_by_side(spark, path, tmp_path):
    """A slow event holds up the cursor, not the events behind it."""
    done = tmp_path / "done"
    done.mkdir()
    cursors, sets = MemoryCursors(), []
    cursors.set = lambda name, cursor: (sets.append(int(cursor)), MemoryCursors.set(cursors, name, cursor))
    consumer = patterns.concurrent("c", waiting_for(done), cursors, ahead=4)
    began = time.monotonic()
    run(spark, Spec(path, cursors, consumer, TO_HEAD, limit=5), str(tmp_path / "cp"))
    assert len(list(done.iterdir())) == 20 and cursors.get("c") == "20" and sets == sorted(sets) and time.monotonic() < began + 50


def test_a_failure_ahead_leaves_the_cursor_behind_it(spark, path, tmp_path):
    done = tmp_path / "done"
    done.mkdir()
    cursors = MemoryCursors()
    consumer = patterns.concurrent("c", waiting_for(done, (8,), 3), cursors, ahead=4)
    with pytest.raises(Exception, match="event 8"):
        run(spark, Spec(path, cursors, consumer, TO_HEAD, limit=5), str(tmp_path / "cp"))
    assert int(cursors.get("c") or 0) <= 7


def test_expected_errors(spark, path, tmp_path):
    """They end a concurrent run as such, and are no dead letters."""
    def stop(row):
        if row["id"] in (5, 9):
            raise errors.Stopped()

    cursors, lost = MemoryCursors(), []
    with pytest.raises(Exception, match="Stopped") as caught:
        run(spark, Spec(path, cursors, patterns.concurrent("c", stop, cursors), TO_HEAD), str(tmp_path / "cp"))
    assert "event 5" in str(caught.value) and cursors.get("c") == "4"
    consumer = patterns.dead_letter("d", stop, lambda rows: lost.extend(rows.collect()))
    run(spark, Spec(path, cursors, consumer, TO_HEAD), str(tmp_path / "cp"))
    assert lost == [] and cursors.get("d") == "20" and consumer.counts == {"dead_letters": 0}


def test_one_scan_for_all_shards(spark, path, tmp_path):
    """A lagging shard replays alone; the cursors of those that return are set when another fails."""
    cursors, seen = MemoryCursors(), {m: [] for m in range(3)}
    cursors.set("p_2_of_3", "12")
    fails = []

    def member(m, name):
        def take(batch, _):
            ids = [r["id"] for r in batch.collect()]
            if m == 0 and fails:
                raise ValueError("no")
            seen[m] += ids

        return Consumer(name, take)

    spec = patterns.parallel(Spec(path, cursors, Consumer("p", None), TO_HEAD), 3, member)
    run(spark, spec, str(tmp_path / "cp"))
    own = {m: [r["id"] for r in spark.read.parquet(path).where(shards.shard(3) == m + 1).orderBy("id").collect()] for m in range(3)}
    assert seen[0] == own[0] and seen[2] == own[2] and seen[1] == [i for i in own[1] if i > 12]
    assert [cursors.get(f"p_{m}_of_3") for m in (1, 2, 3)] == ["20"] * 3
    more = [(i, 1, "x", T0, None, None) for i in range(21, 27)]
    spark.createDataFrame(more, EVENT).write.mode("append").parquet(path)
    fails.append(1)
    with pytest.raises(Exception, match="no"):
        run(spark, spec, str(tmp_path / "cp"))
    assert [cursors.get(f"p_{m}_of_3") for m in (1, 2, 3)] == ["20", "26", "26"]
    fails.clear()
    before = [list(seen[m]) for m in (1, 2)]
    run(spark, spec, str(tmp_path / "cp"))
    assert [seen[1], seen[2]] == before and cursors.get("p_1_of_3") == "26" and sorted(seen[0] + seen[2]) == sorted(i for i in range(1, 27) if i in seen[0] or i in seen[2])
    acked = patterns.parallel_ack(Spec(path, cursors, Consumer("a", None), TO_HEAD), 2, lambda batch, ack: [ack(r["id"]) for r in batch.orderBy("id").limit(1).collect()])
    run(spark, acked, str(tmp_path / "cp"))
    assert {int(cursors.get(f"a_{m}_of_2")) for m in (1, 2)} <= {1, 2, 3}


def test_dead_letter(spark, path, tmp_path):
    cursors, lost = MemoryCursors(), []
    consumer = patterns.dead_letter("d", failing_on_seven(), lambda rows: lost.extend(rows.collect()), retries=2)
    run(spark, Spec(path, cursors, consumer, TO_HEAD), str(tmp_path / "cp"))
    assert [(r["event_id"], r["error_msg"]) for r in lost] == [(7, "ValueError: seven")] and cursors.get("d") == "20"
    tries = patterns.in_tasks(spark.read.parquet(path), failing_on_seven(), retries=2).where("error IS NOT NULL").first()
    assert tries["tries"] == 3


def test_dead_letter_handles_all(spark, path, tmp_path):
    """Every event is handled though the recorder reads nothing."""
    done = tmp_path / "done"
    done.mkdir()

    def handle(row, folder=str(done)):
        open(f"{folder}/{row['id']}", "w").close()

    consumer = patterns.dead_letter("d", handle, lambda rows: rows.limit(0).collect())
    consumer.consume(spark.read.parquet(path), 0)
    assert len(list(done.iterdir())) == 20


def test_shard_objects(spark, path, tmp_path):
    acked, cursors = {}, MemoryCursors()
    parts = patterns.consumer_shards("p", 3, by="foreign_id", formatter=lambda b, m, n: f"{b}-{m}")
    log = spark.read.parquet(path)
    counts = [log.where(p.event_filter()["ok"]).count() for p in parts]
    assert [p.name for p in parts] == ["p-0", "p-1", "p-2"] and sum(counts) == 20

    def consume(batch, ack):
        for r in batch.collect():
            ack(r["id"])
            acked[r["id"]] = True

    specs = patterns.parallel_ack_specs(Spec(path, cursors, Consumer("p", None)), 2, consume, options=TO_HEAD, consumer_options=lambda m: {"lag_alert": None if m else 60.0})
    assert [s.consumer.lag_alert for s in specs] == [60.0, None] and not any(s.consumer.sets_cursor for s in specs)
    for n, spec in enumerate(specs):
        run(spark, spec, str(tmp_path / f"cp{n}"))
    assert sorted(acked) == list(range(1, 21))


def test_concurrent_in_flight(spark, path, tmp_path):
    """At most two events at a time, seen by files that mark what is being handled."""
    place = tmp_path / "now"
    place.mkdir()

    def handle(row, folder=str(place)):
        import os
        import time

        own = f"{folder}/{row['id']}"
        open(own, "w").close()
        time.sleep(0.02)
        held = len(os.listdir(folder))
        os.remove(own)
        if held > 2:
            raise ValueError("too many")

    cursors = MemoryCursors()
    patterns.concurrent("c", handle, cursors, max_in_flight=2)(spark.read.parquet(path).repartition(8), 0)
    assert cursors.get("c") == "20"


def test_parallel_specs(spark, path, tmp_path):
    cursors, seen = MemoryCursors(), {}

    def make(m, name):
        seen[m] = []
        return Consumer(name, lambda batch, _: seen[m].extend(r["id"] for r in batch.collect()))

    base = Spec(path, cursors, Consumer("p", None), TO_HEAD)
    specs = patterns.parallel_specs(base, 3, make)
    assert [s.consumer.name for s in specs] == ["p_1_of_3", "p_2_of_3", "p_3_of_3"]
    for n, spec in enumerate(specs):
        run(spark, spec, str(tmp_path / f"cp{n}"))
    assert sorted(sum(seen.values(), [])) == list(range(1, 21)) and all(cursors.get(s.consumer.name) == "20" for s in specs)


def test_waiting(spark, path):
    log = lambda: spark.read.parquet(path)
    assert patterns.wait_for(log, 3, "0", [1])["id"] == 6
    assert patterns.wait_for(log, 20, "0", [1], poll=lambda: True) is None
    with pytest.raises(TimeoutError):
        patterns.wait_for(log, 20, "0", [1], timeout=0)
    patterns.wait_for_cursor(MemoryCursors(a=5), "a", 5)
    with pytest.raises(TimeoutError):
        patterns.wait_for_cursor(MemoryCursors(a=5), "a", 6, timeout=0)


def test_serving_over_tcp(spark, tmp_path):
    log = MemoryLog()
    for n in range(7):
        log.insert(str(n), n + 1, b"m")
    tcp = serving.TcpServer(serving.Server(log.stream))
    host, port = tcp.address
    open_stream = serving.client(serving.tcp_call(host, port))
    got = []
    with pytest.raises(errors.HeadReached):
        for row in open_stream("5", TO_HEAD):
            got.append(row[0])
    assert got == ["6", "7"]
    spark.dataSource.register(serving.RemoteLog)
    query = spark.readStream.format("remotelog").options(host=host, port=str(port), after="1", pageSize="4").load().writeStream.format("memory").queryName("remote").option("checkpointLocation", str(tmp_path / "cp")).start()
    try:
        import time

        end = time.monotonic() + 60
        while spark.table("remote").count() < 6 and time.monotonic() < end:
            time.sleep(0.2)
    finally:
        query.stop()
    assert [r["id"] for r in spark.table("remote").orderBy("id").collect()] == list("234567")
    tcp.stop()
    with pytest.raises(OSError):
        next(open_stream(""))


def test_serving():
    log = MemoryLog()
    for n in range(4):
        log.insert(str(n), n + 1, b"m" if n else None)
    server = serving.Server(log.stream)
    open_stream = serving.client(server.stream)
    got = []
    with pytest.raises(errors.HeadReached):
        for row in open_stream("1", TO_HEAD):
            got.append((row[0], row[1], row[2], row[4]))
    assert got == [("2", 2, "1", b"m"), ("3", 3, "2", b"m"), ("4", 4, "3", b"m")]
    server.stop()
    with pytest.raises(errors.Stopped):
        next(open_stream(""))
    with pytest.raises(RuntimeError):
        server.stop()


def test_batches_of_a_long_log_come_in_bounded_micro_batches(spark, tmp_path, monkeypatch):
    """Without a limit of its own, a query with state does not take the whole log at once; the batches are the same."""
    monkeypatch.setattr("logweir.streaming.run.STATE_IDS", 30)
    path, seen = str(tmp_path / "log"), []
    spark.range(1, 101).selectExpr("id", "1 AS type", "'k' AS foreign_id", "timestamp '2024-01-01 00:00:00' AS timestamp", "cast(null AS binary) AS metadata", "cast(null AS binary) AS trace").write.parquet(path)
    cursors = MemoryCursors()
    consumer = patterns.BatchConsumer("long", lambda rows: seen.append([(r["batch"], r["id"]) for r in rows.collect()]), cursors=cursors, length=8, together=True)
    run(spark, Spec(path, cursors, consumer, TO_HEAD), str(tmp_path / "cp"))
    assert [len(s) for s in seen] == [24, 32, 32, 8] and cursors.get("long") == "96"
    assert [e for s in seen for e in s] == [((i - 1) // 8 * 8 + 1, i) for i in range(1, 97)]
