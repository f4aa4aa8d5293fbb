"""Operators against golden values and plain models."""

import random
from datetime import datetime, timedelta, timezone

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from logweir import errors
from logweir.operators import batching, cursors, filters, gaps, log, progress, retries, waiting
from logweir.operators.ordering import SHIFTS, with_position, with_previous, with_running_max
from logweir.schema import EVENT, EventColumns
from logweir.sources.blobs import Bucket, json_values
from logweir.sources.memory import MemoryLog
from logweir.sources.polling import Poller

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)


def events(spark, ids, kind=1, foreign="9", step=60):
    return spark.createDataFrame([(i, kind, foreign, T0 + timedelta(seconds=step * n), None, None) for n, i in enumerate(ids)], EVENT)


def ids(frame):
    return sorted(r["id"] for r in frame.select("id").collect())


@pytest.mark.parametrize("keys, shifts", [(range(3, 60, 2), (3, 2)), ([k << 22 for k in range(1, 40)], (16, 16, 16)), ([k << 43 for k in range(1, 40)], SHIFTS), ([3, 4, 1 << 20, 1 << 33, (1 << 33) + 1, 1 << 50, (1 << 50) + 65536, 1 << 62], SHIFTS), ([-(1 << 50), -5, 0, 7], SHIFTS)])
def test_running_values_cross_buckets(spark, keys, shifts):
    rows = spark.createDataFrame([(i, (i * 7) % 11) for i in keys], "id long, v long")
    got = sorted(with_running_max(with_previous(with_position(rows, shifts=shifts), shifts=shifts), "id", "v", "m", shifts=shifts).collect())
    assert len(got) == len(keys)
    best, before = -1, None
    for n, r in enumerate(got, 1):
        best = max(best, r["v"])
        assert (r["pos"], r["prev"], r["m"]) == (n, before, best)
        before = r["id"]


def _folded(rows, length, period):
    """One after the other: rows (part, id, micros)."""
    out, now = [], {}
    for part, i, t in sorted(rows):
        open_ = now.get(part)
        if open_ is None or length and open_[4] == length or period and t >= open_[5] + period:
            now[part] = open_ = [part, 0 if open_ is None else open_[1] + 1, i, i, 0, t]
            out.append(open_)
        open_[3], open_[4] = i, open_[4] + 1
    return sorted(tuple(b[:5]) for b in out)


@pytest.mark.parametrize("length, period, step", [(0, 7, 3), (5, 0, 3), (4, 9, 3), (0, 200, 3), (50, 0, 3), (3, 1000, 3), (0, 1, 3), (6, 30, 40)])
def test_batches_in_parallel(spark, length, period, step):
    """Buckets of few events, batches shorter and longer than a bucket, times that go back, sparse ids."""
    rng = random.Random(length * 1000 + period)
    rows, t = [], 0
    for n in range(120):
        t += rng.randint(0, step) if rng.random() < 0.9 else -rng.randint(0, 2 * step)
        rows.append((n % 3 and 1, (n + 1) << rng.choice([3]), t))
    table = spark.createDataFrame([(p, i, T0 + timedelta(microseconds=t)) for p, i, t in rows], "shard long, id long, timestamp timestamp").repartition(5)
    base = int(T0.timestamp() * 1e6)
    for size in (1, 4, 16, None):
        got = sorted(tuple(r) for r in batching.fold(table, length=length, period_micros=period, size=size).collect())
        assert got == _folded([(0, i, base + t) for _, i, t in rows], length, period), size
    got = sorted(tuple(r) for r in batching.fold(table, length=length, period_micros=period, by="shard", size=8).collect())
    assert got == _folded([(p, i, base + t) for p, i, t in rows], length, period)
    assert batching.fold(table.limit(0), length=length, period_micros=period).count() == 0


def test_pages(spark):
    table = events(spark, range(1, 1101))
    assert ids(log.page(table, 0, 10)) == list(range(1, 11))
    assert log.page(table, 0, 0).count() == log.page(table, 0, -1).count() == 1000
    assert log.head_id(table) == 1100 and log.head_id(table.limit(0)) == 0


def test_lag(spark):
    table = events(spark, range(1, 11))
    now = F.lit(T0 + timedelta(minutes=9))
    assert ids(log.lagged(table, now, F.expr("INTERVAL 5 MINUTES 30 SECONDS"))) == [1, 2, 3, 4]
    assert ids(log.lagged(table, now, F.expr("INTERVAL 5 MINUTES"))) == [1, 2, 3, 4]
    assert ids(log.lagged_prefix(table, now, F.expr("INTERVAL 5 MINUTES"))) == [1, 2, 3, 4, 5]


def test_gaps(spark):
    table = events(spark, [100, 101, 103, 104])
    assert ids(gaps.contiguous(table)) == [100, 101]
    assert [tuple(r) for r in gaps.gaps(table).collect()] == [(101, 103)]
    assert ids(gaps.contiguous(table, 50)) == []
    assert ids(gaps.filled(table)) == [100, 101, 102, 103, 104]
    assert ids(log.without_noops(gaps.filled(table))) == [100, 101, 103, 104]
    assert ids(gaps.missing(events(spark, [1, 4]))) == [2, 3]
    assert ids(gaps.filled(table, older_than=F.lit(T0))) == [100, 101, 103, 104]
    assert gaps.gaps(table.limit(0)).count() == 0


def test_noops(spark):
    table = events(spark, [1], 0, "0").union(events(spark, [2], 0, "7")).union(events(spark, [3], 1, "0"))
    assert ids(log.without_noops(table)) == [2, 3]
    assert tuple(log.page_with_override(table.where("id = 1"), 0).first()) == (0, 1, 1)
    source = log.EventLog(lambda s: table, EventColumns(metadata="metadata", trace="trace"))
    assert ids(source.stream(spark)) == [2, 3] and ids(source.clone(include_noops=True).stream(spark, 1)) == [2, 3] and ids(source.page(spark)) == [2, 3]


def test_inserts(spark):
    rows = spark.createDataFrame([(10, 5, 2), (20, 6, 3)], "seq long, foreign_id long, type int")
    assert [tuple(r) for r in log.new_events(spark, rows, 7).select("id", "foreign_id", "type").orderBy("id").collect()] == [(8, "5", 2), (9, "6", 3)]
    with pytest.raises(PySparkException):
        log.new_events(spark, spark.createDataFrame([(1, 0, 0)], rows.schema), 0).collect()
    with pytest.raises(errors.InvalidEvent):
        log.new_events(spark, rows.withColumn("metadata", F.lit(b"x")), 0)


def test_increasing(spark):
    assert log.checked_increasing(events(spark, [1, 2, 5]).coalesce(1)).count() == 3
    with pytest.raises(PySparkException):
        log.checked_increasing(events(spark, [1, 5, 2]).coalesce(1)).collect()


def test_renamed_columns(spark):
    names = EventColumns("custom_id", "custom_timestamp", "custom_type", "custom_foreign_id")
    table = names.write(events(spark, [1]))
    assert table.columns == ["custom_id", "custom_type", "custom_foreign_id", "custom_timestamp"]
    assert names.read(table).schema.names == EVENT.names


@pytest.mark.parametrize(
    "combine, given, want",
    [
        (filters.all_filters, [], (True, None)),
        (filters.all_filters, [(True,), (False,), (True,)], (False, None)),
        (filters.all_filters, [(True, "e1"), (False,), (True,)], (True, "e1")),
        (filters.all_filters, [(False,), (False, "e1"), (True,)], (False, None)),
        (filters.any_filters, [], (False, None)),
        (filters.any_filters, [(True, "e1"), (False,), (False,)], (False, "e1")),
        (filters.any_filters, [(True,), (False, "e1"), (True,)], (True, None)),
        (filters.any_filters, [(False, "e1"), (False, "e2"), (True,)], (True, None)),
        (filters.any_filters, [(False, "e1"), (False, "e2"), (True, "e3")], (False, "e3")),
    ],
)
def test_filters(spark, combine, given, want):
    outcomes = [filters.outcome(*map(F.lit, g)) for g in given]
    assert tuple(spark.range(1).select(combine(*outcomes).alias("o")).first()["o"]) == want


def test_type_filters(spark):
    table = events(spark, [1]).union(events(spark, [2], 2)).union(events(spark, [3], 3))
    assert ids(filters.include_types(table)) == [1, 2, 3] and ids(filters.include_types(table, [1, 2])) == [1, 2]
    assert ids(table.where(filters.is_any_type())) == []
    only = filters.consumer_outcome([1, 2], filters.outcome(F.col("id") == 1))
    assert [r[0] for r in table.orderBy("id").select(only).collect()] == ["processed", "skipped", "skipped"]
    failing = filters.consumer_outcome([2], filters.outcome(F.lit(True), F.when(F.col("id") == 1, "bad")))
    assert [r[0] for r in table.orderBy("id").select(failing).collect()] == ["skipped", "processed", "skipped"]


def test_metadata_filter(spark):
    table = spark.createDataFrame([(1, b'{"k": 3}'), (2, b"{"), (3, None), (4, b'{"k": 30}')], "id long, metadata binary")
    out = table.select("id", filters.metadata_filter("k bigint", lambda m: m["k"] > 5).alias("o")).orderBy("id").collect()
    assert [(r["o"]["ok"], r["o"]["err"] is None) for r in out] == [(False, True), (False, False), (False, True), (True, True)]


@pytest.mark.parametrize(
    "strings, sets, want",
    [(False, ["20", "20", "3", "21", "110"], [True, False, False, True, True]), (False, ["8", "10", "9"], [True, True, False]), (True, ["abc", "abcd", "aaa"], [True, True, False])],
)
def test_cursor_sets(spark, strings, sets, want):
    frame = spark.createDataFrame([("c", n, v) for n, v in enumerate(sets)], "consumer string, seq long, cursor string")
    assert [r["accepted"] for r in cursors.monotone(frame, strings=strings).orderBy("seq").collect()] == want
    store, got = cursors.BufferedCursors(strings=strings, buffered=False), []
    for v in sets:
        try:
            store.set("c", v)
            got.append(True)
        except errors.CursorNotIncreasing:
            got.append(False)
    assert got == want


def test_cursor_stores():
    store = cursors.BufferedCursors()
    with pytest.raises(errors.InvalidId):
        store.set("c", "abc")
    store.set("c", "5")
    assert store.get("c") == ""
    store.flush()
    assert store.get("c") == "5"
    primary, fallback = cursors.MemoryCursors(), cursors.MemoryCursors(c=3)
    through = cursors.ReadThroughCursors(primary, fallback)
    assert through.get("x") == "" and through.get("c") == "3" and primary.get("c") == "3"


@pytest.mark.parametrize("length, batches", [(4, 5), (10, 2), (15, 1), (20, 1), (40, 0)])
def test_batches(spark, length, batches):
    assert batching.by_count(events(spark, range(1, 21)), length).count() == batches


def test_batch_config(spark):
    with pytest.raises(errors.InvalidBatchConfig):
        batching.fold(events(spark, [1]))


def test_fold_by_part(spark):
    table = events(spark, range(1, 13)).withColumn("shard", F.col("id") % 2)
    got = sorted(tuple(r) for r in batching.fold(table, length=4, by="shard").collect())
    assert got == [(0, 0, 2, 8, 4), (0, 1, 10, 12, 2), (1, 0, 1, 7, 4), (1, 1, 9, 11, 2)]


@pytest.mark.parametrize("order, marks", [([1, 2], [1, 2]), ([3, 5, 4], [3, 3, 5]), ([101, 100, 3], [0, 0, 101])])
def test_watermark(spark, order, marks):
    done = spark.createDataFrame([(i, n) for n, i in enumerate(order, 1)], "id long, done_pos long")
    assert [r["watermark"] for r in progress.watermark(done).orderBy("done_pos").collect()] == marks
    live, spans = progress.Spans(), {}
    for i in sorted(order):
        spans[i] = live.begin(i)
    assert [live.done(spans[i]) or 0 for i in order] == marks


def test_a_span_that_is_never_done_blocks():
    live = progress.Spans()
    first, second, third = (live.begin(i) for i in (10, 20, 30))
    assert live.done(first) == 10 and live.done(third) == 10 and live.done(second) == 30


def model(failures, retries_, count):
    """What a consumer that fails ``failures`` times an event returns, call by call."""
    out = []
    for _ in range(count):
        tried = 0
        while True:
            tried += 1
            if tried > failures or tried > retries_:
                out.append("ok")
                break
            out.append("err")
    return out


@pytest.mark.parametrize("failures, retries_", [(1, 0), (1, 1), (2, 3), (4, 2)])
def test_best_effort(spark, failures, retries_):
    got = retries.best_effort(spark.range(3), F.lit(failures), retries_).collect()
    assert [x for r in got for x in ["err"] * r["returned"] + ["ok"]] == model(failures, retries_, 3)
    assert retries.dead_letters(spark.range(3), F.lit(failures), retries_).count() == (3 if failures > retries_ else 0)
    assert retries.dead_letters(spark.range(3), F.lit(failures), retries_, F.lit(True)).count() == 0


def test_error_store(spark):
    calls = spark.createDataFrame([(n, "c", 7, f"m{n}", T0) for n in range(4)], "seq long, consumer string, event_id long, error_msg string, at timestamp")
    rows = retries.recorded(calls)
    assert [(r["id"], r["error_msg"]) for r in rows.collect()] == [(1, "m0")]
    assert retries.recorded(calls, rows).count() == 0
    assert retries.error_events(calls, rows).count() == 4


def test_bootstrap_and_await(spark):
    stored = spark.createDataFrame([("a", ""), ("b", "2"), ("c", None)], "consumer string, cursor string")
    got = {r["consumer"]: (r["after"], r["from_head"]) for r in waiting.bootstrap(stored, log.head(events(spark, [1, 9]))).collect()}
    assert got == {"a": (9, True), "b": (2, False), "c": (9, True)}
    assert ids(waiting.awaited(events(spark, range(1, 7)), 3, "9", [1])) == [4]
    assert ids(waiting.awaited(events(spark, range(1, 7)), 6, "9", [1])) == []


def test_poller():
    pages, waits = {"": [{"id": 1}, {"id": 2}], "2": [], "3": []}, []
    stream = Poller(lambda c: pages.pop(c, [{"id": 3}]), sleep=waits.append).stream()
    assert [next(stream)["id"] for _ in range(3)] == [1, 2, 3] and waits == [60.0]


def test_memory_log():
    source = MemoryLog()
    for _ in range(3):
        source.insert("1", 2)
    stream = source.stream("1")
    assert [next(stream)[0] for _ in range(2)] == [2, 3]
    with pytest.raises(errors.HeadReached):
        next(stream)
    source.stop()
    with pytest.raises(errors.Stopped):
        next(source.stream())


@pytest.fixture
def bucket(tmp_path):
    blobs = {"2019/12/31/a-1to3": [1, 2, 3], "2020/01/01/b-4to6": [4, 5, 6], "2020/02/10/c-7": [7], "2021/d-1to3": [1, 2, 3], "2021/e-4to5": [4, 5]}
    for key, records in blobs.items():
        path = tmp_path / key
        path.parent.mkdir(parents=True, exist_ok=True)
        path.write_text("".join(f'{{"id": {i}, "field": "x|}}{{"}}' for i in records))
    return tmp_path


def records(frame):
    import json

    return [json.loads(bytes(r["metadata"]))["id"] for r in frame.collect()]


def test_blob_log(spark, bucket):
    source = Bucket(str(bucket))
    assert records(source.stream(spark)) == [1, 2, 3, 4, 5, 6, 7, 1, 2, 3, 4, 5]
    assert records(source.stream(spark, "2019/12/31/a-1to3|eof"))[:4] == [4, 5, 6, 7]
    assert records(source.stream(spark, "2020/01/01/b-4to6|0"))[:3] == [5, 6, 7]
    assert records(source.stream(spark, "2020|eof"))[:3] == [4, 5, 6]
    assert records(Bucket(str(bucket), prefix="2020/01").stream(spark)) == [4, 5, 6]
    got = [r["id"] for r in source.stream(spark).collect()][:4]
    assert got == ["2019/12/31/a-1to3|01|0", "2019/12/31/a-1to3|01|1", "2019/12/31/a-1to3|eof", "2020/01/01/b-4to6|01|0"]
    for cursor, error in [("2020/02/10/c-7|01|5", errors.CursorOutOfRange), ("2020/02/10/c-7|01|0", errors.CursorAtEnd)]:
        with pytest.raises(PySparkException, match=error.__name__):
            source.stream(spark, cursor).collect()
    with pytest.raises(errors.LogError):
        source.stream(spark, "a|b|c|d")


def test_decoder():
    assert list(json_values(b' {"a":1}{"b":2}\n[3] 4')) == [b'{"a":1}', b'{"b":2}', b"[3]", b"4"]
    with pytest.raises(ValueError):
        list(json_values(b'{"a":1}{'))
