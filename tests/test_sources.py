"""Blob and poll sources as streams: order, resumption, listing behind a key, pages that are read again."""

import json
import time

import pytest

from logweir import errors
from logweir.functions import blobs as cursors
from logweir.operators.cursors import BufferedCursors, TableCursors
from logweir.sources import polling
from logweir.sources.blobs import BlobStreamReader, Bucket, Listing, json_values


def put(folder, key, ids, text="{}"):
    path = folder / key
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join(json.dumps({"id": i}) for i in ids))


def test_keys_in_order_behind_a_key(tmp_path):
    keys = ["a", "a.b", "a/x", "a/y/1", "a/y/2", "a0", "b/1", "b/2", "c|d"]
    for k in keys:
        if k == "a":
            continue
        put(tmp_path, k, [1])
    keys = sorted(k for k in keys if k != "a")
    listing = lambda prefix="": Listing(str(tmp_path), prefix)
    for after in ["", "a", "a/", "a/x", "a/y/1", "a/y/15", "b", "b/2", "zzz", *keys]:
        assert [k for k, _ in listing().behind(after)] == [k for k in keys if k > after]
        assert [k for k, _ in listing("a/y").behind(after)] == [k for k in keys if k > after and k.startswith("a/y")]
    assert [k for k, _ in listing().behind("a/x", including=True)][0] == "a/x"


def test_a_look_costs_what_is_new(tmp_path):
    for day in range(200):
        put(tmp_path, f"2024/{day // 20:02d}/{day:03d}/blob", [day])
    listing = Listing(str(tmp_path))
    assert len(list(listing.behind(""))) == 200 and listing.looks == 1 + 1 + 10 + 200
    listing.looks = 0
    assert [k for k, _ in listing.behind("2024/09/198/blob")] == ["2024/09/199/blob"]
    # The folders on the way to the key, and the one with a new blob.
    assert listing.looks == 5


def test_json_in_parts():
    values = [b'{"a": "' + b"x" * 3_000_000 + b'"}', b"12", b'"\xc3\xa9"', b"[1, 2]", b"true", b"-1.5e3"]

    class Slow:
        def __init__(self, data, step):
            self.data, self.step, self.at = data, step, 0

        def read(self, n):
            part = self.data[self.at : self.at + min(n, self.step)]
            self.at += len(part)
            return part

    for step in (1, 7, 1 << 20):
        data = b" ".join(values[1:]) if step == 1 else b"\n".join(values)
        assert list(json_values(Slow(data, step))) == (values[1:] if step == 1 else values)
    with pytest.raises(ValueError):
        list(json_values(Slow(b'{"a": 1}{"b', 3)))


def test_short_values_cost_their_own_length():
    """A million values in a part each: moving the rest of the part for each took a minute and more."""
    began = time.monotonic()
    assert sum(1 for _ in json_values(b"1 " * 1_000_000)) == 1_000_000
    assert time.monotonic() - began < 15


def follow(spark, bucket, store, seen, **options):
    bucket.follow(spark, lambda frame: seen.append([json.loads(bytes(r["metadata"]))["id"] for r in frame.collect()]), store, "c", rounds=1, **options)


def test_cursors_of_blobs_with_related_names(spark, tmp_path):
    """Names of which one begins with the other: the cursor goes on in the order of keys."""
    put(tmp_path, "app.log", [1, 2])
    put(tmp_path, "app.log.1", [3])
    bucket = Bucket(f"file://{tmp_path}")
    store, seen = TableCursors(spark, f"{tmp_path}/../cursors-{tmp_path.name}", buffered=False, rank=cursors.rank_of), []
    follow(spark, bucket, store, seen)
    assert seen == [[1, 2, 3]] and store.get("c") == "app.log.1|eof"
    put(tmp_path, "app.log.2", [4])
    follow(spark, bucket, store, seen)
    follow(spark, bucket, store, seen)
    assert seen == [[1, 2, 3], [4]] and store.clone().get("c") == "app.log.2|eof"
    with pytest.raises(errors.CursorNotIncreasing):
        store.set("c", "app.log|eof")


def test_small_micro_batches_and_resumption_in_mid_blob(spark, tmp_path):
    for k in range(5):
        put(tmp_path, f"d/{k}", range(10 * k, 10 * k + 3))
    bucket, store, seen = Bucket(str(tmp_path)), BufferedCursors(rank=cursors.rank_of, buffered=False), []
    store.set("c", "d/1|01|0")

    def fail(frame):
        seen.append([json.loads(bytes(r["metadata"]))["id"] for r in frame.collect()])
        if seen[-1][0] == 30 and len(seen) < 4:
            raise ValueError("no")

    with pytest.raises(Exception, match="no"):
        bucket.follow(spark, fail, store, "c", rounds=1, maxBlobs="1")
    while len(seen) < 5:
        try:
            bucket.follow(spark, fail, store, "c", rounds=1, maxBlobs="1")
        except Exception:
            continue
        if store.get("c") == "d/4|eof":
            break
    flat = [i for s in seen for i in s]
    assert flat[:5] == [11, 12, 20, 21, 22] and sorted(set(flat)) == [11, 12, *range(20, 23), *range(30, 33), *range(40, 43)] and store.get("c") == "d/4|eof"


def test_cursors_are_not_parsed_while_sorting(spark, tmp_path):
    """The sort compares columns; the order is that of keys and offsets."""
    put(tmp_path, "app.log", range(12))
    put(tmp_path, "app.log.1", [12])
    rows = Bucket(str(tmp_path)).stream(spark)
    assert [json.loads(bytes(r["metadata"]))["id"] for r in rows.collect()] == list(range(13))
    sorts = [line for line in rows._jdf.queryExecution().optimizedPlan().toString().splitlines() if "Sort [" in line]
    assert sorts and not any("split(" in line for line in sorts)


def test_offsets_of_blobs(tmp_path):
    for k in range(5):
        put(tmp_path, f"d/{k}", range(3))
    reader = BlobStreamReader({"url": str(tmp_path), "maxBlobs": "2"}, json_values)
    ends = [reader.latestOffset()["cursor"] for _ in range(4)]
    assert ends == ["d/1|eof", "d/3|eof", "d/4|eof", "d/4|eof"]
    parts = reader.partitions({"cursor": ends[0]}, {"cursor": ends[1]})
    assert [p.keys for p in parts] == [["d/2", "d/3"]]
    # A reader that knows nothing plans the same; in mid-blob it skips.
    fresh = BlobStreamReader({"url": str(tmp_path), "taskBytes": "1"}, json_values)
    parts = fresh.partitions({"cursor": "d/2|01|1"}, {"cursor": "d/3|eof"})
    assert [(p.keys, p.skip) for p in parts] == [(["d/2"], 2), (["d/3"], 0)]
    assert [r for b in fresh.read(parts[0]) for r in b.column(0).to_pylist()] == ["d/2|eof"]


def test_own_decoder(spark, tmp_path):
    (tmp_path / "a").write_bytes(b"one\ntwo\nthree")
    bucket = Bucket(str(tmp_path), decoder=lambda blob: blob.read().split(b"\n"))
    assert [(r["id"], bytes(r["metadata"])) for r in bucket.stream(spark).collect()] == [("a|01|0", b"one"), ("a|01|1", b"two"), ("a|eof", b"three")]


def polled(folder, n):
    """An API that gives each page once: what it gave is gone."""

    def poll(cursor, folder=str(folder), n=n):
        import os

        at = int(cursor or 0)
        if at >= n or os.path.exists(f"{folder}/{at}"):
            return []
        open(f"{folder}/{at}", "w").close()
        return [{"id": i, "type": 1, "foreign_id": f"k{i}", "metadata": b"m", "timestamp": "2024-01-01T00:00:00+00:00"} for i in range(at + 1, min(at + 3, n) + 1)]

    return poll


def test_a_failed_micro_batch_sees_the_same_page(spark, tmp_path):
    given = tmp_path / "given"
    given.mkdir()
    seen, fails = [], [True]
    checkpoint, journal = str(tmp_path / "cp"), f"{tmp_path}/journal"

    def step(batch, _):
        seen.append(sorted(int(r["id"]) for r in batch.collect()))
        if seen[-1] and seen[-1][0] == 4 and fails:
            fails.pop()
            raise ValueError("no")

    def start():
        stream = polling.live(spark, polled(given, 8), journal, backoff=0.1, pages=1)
        return stream.writeStream.foreachBatch(step).option("checkpointLocation", checkpoint).trigger(processingTime="100 milliseconds").start()

    query = start()
    with pytest.raises(Exception, match="no"):
        query.awaitTermination(60)
    query = start()
    import time

    end = time.monotonic() + 60
    while [7, 8] not in seen and time.monotonic() < end:
        time.sleep(0.1)
    query.stop()
    assert [s for s in seen if s] == [[1, 2, 3], [4, 5, 6], [4, 5, 6], [7, 8]]


def test_pages_that_nobody_planned_come_next(tmp_path):
    clock = [0.0]
    options = {"journal": str(tmp_path / "j"), "backoff": "5", "pages": "2"}
    asked = []

    def poll(cursor):
        asked.append(cursor)
        at = int(cursor or 0)
        return [{"id": at + 1}, {"id": at + 2}] if at < 4 else []

    reader = polling.PollReader(options, poll, lambda: clock[0])
    assert reader.initialOffset() == {"page": 0} and reader.latestOffset() == {"page": 2}
    again = polling.PollReader(options, poll, lambda: clock[0])
    assert again.latestOffset() == {"page": 2} and asked == ["", "2", "4"]
    assert again.latestOffset() == {"page": 2} and len(asked) == 3
    clock[0] = 6.0
    again.latestOffset()
    assert asked == ["", "2", "4", "4"]
    assert [(p.first, p.last) for p in again.partitions({"page": 0}, {"page": 2})] == [(1, 2)]
    assert [b.column(0).to_pylist() for b in again.read(polling.Pages(1, 2))] == [["1", "2"], ["3", "4"]]
    again.commit({"page": 2})
    assert again.journal.last() == 2 and not (tmp_path / "j" / "000000000001").exists()


def test_pages_of_a_table_with_holes(spark, tmp_path):
    """Pages hold the next events whatever ids are missing; each file of ids is read once, each page polled once."""
    ids = [*range(1, 31), *range(500, 520), 9000, *range(9100, 9130)]
    polling.write_ids(spark.createDataFrame([(i,) for i in reversed(ids)], "id long"), f"{tmp_path}/ids", most=25)
    pages = polling.TablePages(f"{tmp_path}/ids", 10)
    reader = polling.PollReader({"journal": str(tmp_path / "j"), "backoff": "5", "pages": "100"}, pages, lambda: 0.0)
    reads = []
    reader.journal.read = lambda n, read=reader.journal.read: reads.append(n) or read(n)
    assert reader.latestOffset() == {"page": 9} and not reads
    assert [int(i) for b in reader.read(polling.Pages(1, 9)) for i in b.column(0).to_pylist()] == ids
    assert pages.opened == len(pages.files) > 1 and pages("") == [{"id": i} for i in ids[:10]] and pages("9129") == []


def test_journals_with_a_line_for_each_event(tmp_path):
    journal = polling.Journal(str(tmp_path / "j"))
    (tmp_path / "j" / "000000000001").write_text('{"id": 1}\n{"id": 2}\n')
    journal.write(2, [{"id": 3, "metadata": b"m"}])
    assert journal.read(1) == [{"id": 1}, {"id": 2}] and journal.read(2) == [{"id": 3, "metadata": "6d"}]
