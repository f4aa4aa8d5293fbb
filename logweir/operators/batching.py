"""Batches by length, by period, or both, whichever ends first.

The rule by period is a recurrence: where a batch begins depends on where the one before it began. It is
still folded in parallel. Events fall into buckets of consecutive positions. For every event of a bucket at
which a batch may begin first, the bucket works out where the last batch in it begins then: a function
from how the bucket is entered to how it is left. One row a bucket, these functions are applied one after
the other, which tells each bucket how it is entered; then all buckets list their batches side by side.

A batch that is open where a bucket begins ends within one period, or ``length`` events, so a function
covers only as many events as one batch holds. Buckets are several times that, up to ``LARGEST``.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from logweir.errors import InvalidBatchConfig
from logweir.operators.ordering import with_position

#: Events in a bucket, at least and at most; buckets hold about so many batches' events.
SMALLEST, LARGEST, BATCHES = 1 << 16, 1 << 22, 16


def by_count(events: DataFrame, length: int) -> DataFrame:
    """(batch, first_id, last_id, n) of the full batches; a rest stays unacknowledged."""
    if length <= 0:
        raise InvalidBatchConfig("length")
    rows = with_position(events.select("id")).withColumn("batch", F.floor((F.col("pos") - 1) / length).cast("bigint"))
    return rows.groupBy("batch").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n")).where(F.col("n") == length)


def _next(at: np.ndarray, length: int, period: int) -> np.ndarray:
    """For a batch that begins at each event: where the next begins, or the number of events."""
    n = len(at)
    out = np.full(n, n, np.int64)
    if period:
        if (at[1:] >= at[:-1]).all():
            out = np.searchsorted(at, at + period, "left")
        else:
            # From the back: the events that are later than all between, nearest last.
            times, places = [], []
            for j in range(n - 1, -1, -1):
                k = bisect.bisect_right(times, -(at[j] + period)) - 1
                if k >= 0:
                    out[j] = places[k]
                while times and -times[-1] <= at[j]:
                    times.pop()
                    places.pop()
                times.append(-at[j])
                places.append(j)
    return np.minimum(out, np.arange(n) + length) if length else out


class Bucket:
    """The events of one bucket in order of ids."""

    def __init__(self, rows: pa.Table, length: int, period: int):
        rows = rows.sort_by("id")
        self.ids, self.at = rows["id"].to_numpy(), rows["at"].to_numpy()
        self.length, self.period, self.n = length, period, len(self.ids)
        self.next = _next(self.at, length, period).tolist()

    def function(self, before: int | None) -> dict[str, np.ndarray]:
        """For each event at which a batch may begin first: the latest time up to it, and of the last
        batch then its first id, time and events, and how many batches begin. ``before`` is the
        latest time of all buckets before."""
        last, begun = list(range(self.n)), [1] * self.n
        for j in range(self.n - 1, -1, -1):
            k = self.next[j]
            if k < self.n:
                last[j], begun[j] = last[k], begun[k] + 1
        latest = np.maximum.accumulate(self.at)
        ends = [self.n - 1]
        if before is None:
            ends.append(0)
        if before is not None and self.period:
            ends.append(int(np.searchsorted(latest, before + self.period, "left")))
        if before is not None and self.length:
            ends.append(self.length)
        k = min(ends) + 1
        left = np.array(last[:k])
        return {"latest": latest[:k], "first": self.ids[left], "start": self.at[left], "held": self.n - left, "begun": np.array(begun[:k])}

    def pieces(self, entry: int, number: int) -> Iterator[tuple[int, int, int, int]]:
        """(batch, first id, last id, events) of what the bucket holds of each batch, if one begins at
        ``entry`` and is number ``number``; the events before are the batch before's."""
        starts = [0] if entry else []
        at = entry
        while at < self.n:
            starts.append(at)
            at = self.next[at]
        for k, (a, b) in enumerate(zip(starts, [*starts[1:], self.n], strict=True)):
            yield number - (entry > 0) + k, int(self.ids[a]), int(self.ids[b - 1]), b - a


_FIELDS = ["latest", "first", "start", "held", "begun"]
_FUNCTION = "part long, bucket long, n long, " + ", ".join(f"{f} array<long>" for f in _FIELDS)


def _entered(length: int, period: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """(part, bucket, entry, number) of buckets that come in order."""
        now, start, held, number = None, 0, 0, 0
        for batch in batches:
            out = []
            for i, (part, bucket, n) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                f = {k: batch.column(k)[i].values.to_numpy() for k in _FIELDS}
                if part != now:
                    now, number, entry = part, 0, 0
                else:
                    entry = n
                    if period:
                        entry = min(entry, int(np.searchsorted(f["latest"], start + period, "left")))
                    if length:
                        entry = min(entry, length - held)
                out.append((part, bucket, entry, number))
                if entry < n:
                    start, held = int(f["start"][entry]), int(f["held"][entry])
                    number += int(f["begun"][entry])
                else:
                    held += n
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out, strict=True)], names=["part", "bucket", "entry", "number"])

    return run


def fold(events: DataFrame, *, length: int = 0, period_micros: int = 0, by: str | None = None, size: int | None = None) -> DataFrame:
    """(part, batch, first_id, last_id, n): greedy batches anchored at their first event.

    A batch ends before the event that is a period or more after its first one, or with its
    ``length``-th event. With ``by``, a column such as the shard, each of its values has batches of its own.
    ``size`` sets the events of a bucket."""
    if length <= 0 and period_micros <= 0:
        raise InvalidBatchConfig("a batch needs a length or a period")
    part = F.col(by).cast("bigint") if by else F.lit(0).cast("bigint")
    rows = events.select(part.alias("part"), "id", F.unix_micros("timestamp").alias("at"))
    if size is None:
        size = _size(rows, length, period_micros)
    rows = with_position(rows).select("part", F.floor((F.col("pos") - 1) / size).cast("bigint").alias("bucket"), "id", "at")
    cells = rows.groupBy("part", "bucket").agg(F.max("at").alias("latest"))
    earlier = Window.partitionBy("part").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)
    # Columns of their own: the rows that they meet have the same ancestors.
    cells = cells.select(F.col("part").alias("part"), F.col("bucket").alias("bucket"), F.max("latest").over(earlier).alias("before"))
    keys = ["part", "bucket"]

    def function(key: tuple, own: pa.Table, cell: pa.Table) -> pa.Table:
        bucket = Bucket(own, length, period_micros)
        f = bucket.function(cell["before"][0].as_py())
        kinds = [pa.int64()] * 3 + [pa.list_(pa.int64())] * len(_FIELDS)
        values = [key[0].as_py(), key[1].as_py(), bucket.n, *(f[k] for k in _FIELDS)]
        return pa.table([pa.array([v], t) for v, t in zip(values, kinds, strict=True)], names=[*keys, "n", *_FIELDS])

    functions = rows.groupBy(*keys).cogroup(cells.groupBy(*keys)).applyInArrow(function, _FUNCTION)
    entered = functions.repartition("part").sortWithinPartitions(*keys).mapInArrow(_entered(length, period_micros), "part long, bucket long, entry long, number long")

    def pieces(key: tuple, own: pa.Table, entry: pa.Table) -> pa.Table:
        found = Bucket(own, length, period_micros).pieces(entry["entry"][0].as_py(), entry["number"][0].as_py())
        columns = list(zip(*found, strict=True))
        return pa.table([pa.array([key[0].as_py()] * len(columns[0]), pa.int64()), *(pa.array(c, pa.int64()) for c in columns)], names=["part", "batch", "first_id", "last_id", "n"])

    found = rows.groupBy(*keys).cogroup(entered.groupBy(*keys)).applyInArrow(pieces, "part long, batch long, first_id long, last_id long, n long")
    return found.groupBy("part", "batch").agg(F.min("first_id").alias("first_id"), F.max("last_id").alias("last_id"), F.sum("n").alias("n"))


def _size(rows: DataFrame, length: int, period: int) -> int:
    """Events of a bucket: some batches' worth."""
    n, first, last = rows.agg(F.count(F.lit(1)), F.min("at"), F.max("at")).first()
    most = n or 0
    if period and last is not None and last > first:
        most = min(most, n * period // (last - first))
    if length:
        most = min(most, length)
    return min(LARGEST, max(SMALLEST, BATCHES * most))
