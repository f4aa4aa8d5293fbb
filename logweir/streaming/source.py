"""The log as a streaming source whose offset is the cursor.

``latestOffset`` is the end of the contiguous, old-enough prefix: rows behind a hole, or younger than
the lag, stay unread and are never lost. A log with a commit log is known from its records: which files there
are, their ids and the time of their newest, so that a look at the head reads the records since the last
look and lists nothing else. A folder without one is listed, and known from the statistics in its files'
footers: a row group whose ids fill their range needs no look inside. Only files or groups with holes or
young events are read, their id and time alone, one group at a time, and what a file tells is kept
until the file changes. Batches are planned as id ranges with the files that hold them, one
partition each; a task opens its own files alone, with the range pushed down, and fails where ids do not
rise. With ``availableNow`` a query drains to that head.

Paths may be on any file system that pyarrow knows by URL: local, HDFS, S3, GCS.
"""

from __future__ import annotations

import time
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logweir.commits import DataFile, Snapshot, advanced
from logweir.errors import NotIncreasing
from logweir.options import StreamOptions

#: Ids in one partition of a batch; rows and bytes of a file's column that a task decodes at once.
RANGE, ROWS, BUFFER = 250_000, 10_000, 1 << 18
SCHEMA = "id long, type int, foreign_id string, timestamp timestamp, metadata binary, trace binary"
_KINDS = {"id": pa.int64(), "type": pa.int32(), "foreign_id": pa.string(), "timestamp": pa.timestamp("us", "UTC"), "metadata": pa.binary(), "trace": pa.binary()}
EMPTY = pa.table({k: pa.array([], t) for k, t in _KINDS.items()})


class IdRange(InputPartition):
    def __init__(self, start: int, end: int, files: list[str]):
        super().__init__(start)
        self.start, self.end, self.files = start, end, files


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path.removeprefix("file:"))


def _micros(column) -> pa.Array:
    return pc.cast(pc.cast(column, pa.timestamp("us")), pa.int64())


#: A piece of a log: first and last id, time of the youngest, and its file.
Run = tuple[int, int, int | None, str]


class Intervals:
    """The ids of a log's files as sorted runs, file by file.

    ``commits`` is the folder of its commit log, by default ``_log`` in the log's own."""

    def __init__(self, path: str, commits: str | None = None, table: str = "events"):
        self.path, self.commits, self.table = path.rstrip("/"), commits or f"{path.rstrip('/')}/_log", table
        self.known: dict[tuple, list[Run]] = {}
        self.state = Snapshot()
        #: Files that were opened, and listings made: what a look costs.
        self.opened, self.listed = 0, 0

    def _committed(self) -> list[DataFile] | None:
        system, inner = _place(self.commits)
        found = system.get_file_info(fs.FileSelector(inner, allow_not_found=True))

        def read(name: str) -> bytes:
            with system.open_input_file(f"{inner}/{name}") as raw:
                return raw.read()

        self.state = advanced(self.state, [f.base_name for f in found], read)
        return self.state.table(self.table).files if self.state.version else None

    def _group(self, file: pq.ParquetFile, g: int, old: int | None) -> list[Run]:
        meta = file.metadata.row_group(g)
        # Times of 96 bits have no statistics that can be read.
        at = {c.path_in_schema: c.statistics for c in map(meta.column, range(meta.num_columns)) if c.physical_type != "INT96"}
        ids, times = at["id"], at.get("timestamp")
        top = _micros(pa.array([times.max])).to_pylist()[0] if old is not None and times is not None and times.has_min_max else None
        aged = old is None or top is not None and top <= old
        if aged and ids is not None and ids.has_min_max and ids.max - ids.min + 1 == meta.num_rows:
            return [(ids.min, ids.max, top)]
        table = file.read_row_group(g, columns=["id"] if aged else ["id", "timestamp"]).sort_by("id")
        number = table["id"].to_numpy()
        if not len(number):
            return []
        starts = {0, *(np.flatnonzero(np.diff(number) > 1) + 1).tolist()}
        micros = None if aged else _micros(table["timestamp"]).to_numpy()
        if not aged:
            starts |= set(np.flatnonzero(micros > old)[:1].tolist())
        ends = [*sorted(starts)[1:], len(number)]
        return [(int(number[a]), int(number[b - 1]), top if aged else int(micros[a:b].max())) for a, b in zip(sorted(starts), ends, strict=True)]

    def _inside(self, key: tuple, old: int | None) -> list[Run]:
        """The runs of one file, which ``key`` begins with."""
        # Events only grow older: a file that held none too young is not looked at again.
        kept = self.known.get(key)
        if kept is None or old is not None and any(t is None or t > old for _, _, t, _ in kept):
            self.opened += 1
            system, _ = _place(self.path)
            with system.open_input_file(key[0]) as raw:
                file = pq.ParquetFile(raw)
                kept = [(*r, key[0]) for g in range(file.metadata.num_row_groups) for r in self._group(file, g, old)]
        return kept

    def runs(self, after: int, old: int | None) -> list[Run]:
        """Runs that end behind ``after``; with ``old`` (micros), one starts at each group's first younger event."""
        system, inner = _place(self.path)
        out, seen = [], {}
        committed = self._committed()
        if committed is not None:
            for f in committed:
                if f.last <= after:
                    continue
                path = f"{inner}/{f.path}"
                if f.solid and (old is None or f.newest is not None and f.newest <= old):
                    out.append((f.first, f.last, f.newest, path))
                    continue
                key = (path, f.rows)
                seen[key] = self._inside(key, old)
                out += [r for r in seen[key] if r[1] > after]
        else:
            self.listed += 1
            for info in system.get_file_info(fs.FileSelector(inner, recursive=True)):
                name = info.path[len(inner) :]
                if not info.is_file or not info.path.endswith(".parquet") or any(p[:1] in "_." for p in name.strip("/").split("/")):
                    continue
                key = (info.path, info.size, info.mtime_ns)
                seen[key] = self._inside(key, old)
                out += [r for r in seen[key] if r[1] > after]
        self.known = seen
        out.sort(key=lambda r: r[:2])
        for before, r in pairwise(out):
            if r[0] <= before[1]:
                raise NotIncreasing(f"ids {r[0]} to {min(r[1], before[1])} are in {before[3]} and {r[3]}")
        return out


def head_of(path: str, **log: str) -> int:
    """The last id of a log, 0 if it is empty."""
    return max((r[1] for r in Intervals(path, **log).runs(0, None)), default=0)


class EventLogSource(DataSource):
    """Options: path, after, fromHead, lagMicros, gaps (block, the default, or skip), rangeIds,
    limit, the ids in a micro-batch at most, marks, to give only the last id of each range to those who
    read the events elsewhere, and commits and table, if the commit log lies elsewhere."""

    @classmethod
    def name(cls) -> str:
        return "eventlog"

    def schema(self) -> str:
        return SCHEMA

    def streamReader(self, schema):
        return EventLogStreamReader(self.options)


class EventLogStreamReader(DataSourceStreamReader):
    def __init__(self, options):
        self.path, self.after = options["path"], int(options.get("after") or 0)
        self.options = StreamOptions.from_source_options(options)
        self.block = options.get("gaps", "block") == "block"
        self.range = int(options.get("rangeIds", RANGE))
        self.limit = int(options.get("limit") or 0)
        self.marks = str(options.get("marks", "false")).lower() == "true"
        self.log = {k: options[k] for k in ("commits", "table") if options.get(k)}
        self.files = Intervals(self.path, **self.log)
        self.end: int | None = None
        #: What the last look found: the runs behind an id, and the end of what may be read.
        self.seen: list[Run] = []
        self.seen_from, self.seen_to = 0, -1

    def initialOffset(self) -> dict:
        return {"after": head_of(self.path, **self.log) if self.options.from_head else self.after}

    def _look(self) -> None:
        lag = int(self.options.lag.total_seconds() * 1e6)
        old = time.time_ns() // 1000 - lag if lag else None
        self.seen = runs = self.files.runs(self.end, old)
        # A run with an event too young ends the prefix; runs are cut where that matters.
        young = min((a for a, _, t, _ in runs if old is not None and t > old), default=None)
        end = self.end
        for a, b, _, _ in runs:
            if young is not None and a >= young:
                break
            # The empty cursor takes the first id as it is.
            if self.block and end and a > end + 1:
                break
            end = max(end, b if young is None else min(b, young - 1))
        self.seen_from, self.seen_to = self.end, end

    def latestOffset(self) -> dict:
        """The end of what may be read now. Bounded batches are cut from one look until they come to its end."""
        if self.end is None:
            self.end = self.initialOffset()["after"]
        if self.seen_to <= self.end:
            self._look()
        end = self.seen_to
        if self.limit and end > self.end:
            # From the empty cursor, ids are counted from the first there is.
            first = self.end if self.end else min(r[0] for r in self.seen) - 1
            end = min(end, first + self.limit)
        self.end = end
        return {"after": self.end}

    def partitions(self, start: dict, end: dict) -> list[IdRange]:
        """Ranges of at most so many ids that exist, however far apart they lie."""
        lo, hi = start["after"], end["after"]
        parts, first, held = [], lo, 0
        files: dict[str, None] = {}
        known = self.seen_from <= lo and hi <= self.seen_to
        for a, b, _, path in self.seen if known else self.files.runs(lo, None):
            a = max(a, lo + 1)
            while a <= min(b, hi):
                stop = min(b, hi, a + self.range - held - 1)
                held += max(0, stop - a + 1)
                files[path] = None
                a = stop + 1
                if held >= self.range:
                    parts.append(IdRange(first, stop, list(files)))
                    first, held, files = stop, 0, {}
        return parts + [IdRange(first, hi, list(files))] * (held > 0)

    def read(self, part: IdRange) -> Iterator[pa.RecordBatch]:
        if self.marks:
            yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip([part.end, *[None] * 5], _KINDS.values(), strict=True)], names=list(_KINDS))
            return
        system, _ = _place(self.path)
        table = pa.concat_tables([EMPTY, *(t for path in part.files for t in self._pieces(system, path, part))]).sort_by("id")
        ids = table["id"].to_numpy()
        if (ids[1:] <= ids[:-1]).any():
            raise NotIncreasing(f"an id in {part.start + 1} to {part.end} is there twice")
        yield from table.to_batches(max_chunksize=ROWS)

    def _pieces(self, system: fs.FileSystem, path: str, part: IdRange) -> Iterator[pa.Table]:
        """The rows of one file in a range, a few at a time: what else its row groups hold is let go at once."""
        with system.open_input_file(path) as raw:
            file = pq.ParquetFile(raw, buffer_size=BUFFER, pre_buffer=False)
            for g in range(file.metadata.num_row_groups):
                meta = file.metadata.row_group(g)
                at = next(c.statistics for c in map(meta.column, range(meta.num_columns)) if c.path_in_schema == "id")
                if at is not None and at.has_min_max and (at.max <= part.start or at.min > part.end):
                    continue
                names = [k for k in _KINDS if k in file.schema_arrow.names]
                for rows in file.iter_batches(ROWS, row_groups=[g], columns=names, use_threads=False):
                    ids = rows.column("id")
                    rows = rows.filter(pc.and_(pc.greater(ids, part.start), pc.less_equal(ids, part.end)))
                    if len(rows):
                        yield pa.table({k: pc.cast(rows.column(k), t) if k in names else pa.nulls(len(rows), t) for k, t in _KINDS.items()})

    def commit(self, end: dict) -> None:
        pass


def register(spark: SparkSession) -> None:
    spark.dataSource.register(EventLogSource)
