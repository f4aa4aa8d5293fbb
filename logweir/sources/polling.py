"""A paged API as a log: a function from a cursor to the next page of events.

``Poller`` gives the events one by one. ``live`` makes them a stream. An API may not give a page twice, so
each page is written to a journal in a shared folder before its offset is known to the engine: a
micro-batch that fails, or a query that starts again from its checkpoint, reads the same pages from there. The
offset is the number of pages. A page that was journalled when the query died is the next page of the
one that comes after; the API is asked again from its last event on. Pages that a micro-batch has committed
are deleted, but for the last, whose cursor goes on.
"""

from __future__ import annotations

import json
import time
import uuid
from bisect import bisect_right
from collections.abc import Callable, Iterator
from datetime import datetime, timezone

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceStreamReader, InputPartition

from logweir.operators.ordering import with_position

#: Seconds to wait after an empty page; pages that one task reads; ids in a file that pages are cut from.
BACKOFF, TASK, FILE = 60.0, 25, 1_000_000
SCHEMA = "id string, type int, foreign_id string, timestamp timestamp, metadata binary, trace binary, page long"


class Poller:
    """Events of a poll function, one by one; the cursor is the id of the event given out last."""

    def __init__(self, poll: Callable[[str], list], *, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep, id_of: Callable = lambda e: e["id"]):
        self.poll, self.backoff, self.sleep, self.id_of = poll, backoff, sleep, id_of

    def stream(self, after: str = "") -> Iterator:
        cursor = after
        while True:
            page = self.poll(cursor)
            if not page:
                self.sleep(self.backoff)
            for event in page:
                cursor = str(self.id_of(event))
                yield event


def _place(url: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url)


def write_ids(events: DataFrame, url: str, *, most: int = FILE) -> None:
    """The ids of a log in order, as files that ``TablePages`` reads."""
    events.select("id").orderBy("id").write.option("maxRecordsPerFile", most).parquet(url)


class TablePages:
    """A poll function over ``write_ids``: the next ``limit`` ids behind a cursor, however far apart they lie.

    A page is looked up in its file, and one file's ids are held at a time; ``opened`` counts the files that were read."""

    def __init__(self, url: str, limit: int):
        self.url, self.limit, self.opened = url, limit, 0
        self.files: list[tuple[int, str]] | None = None
        self.held: tuple[int, np.ndarray] | None = None

    def _found(self) -> list[tuple[int, str]]:
        """(first id, path) of the files, in order of ids."""
        system, path = _place(self.url)
        out = []
        for info in system.get_file_info(fs.FileSelector(path)):
            if info.is_file and info.base_name.endswith(".parquet") and info.base_name[0] not in "_.":
                with system.open_input_file(info.path) as raw:
                    meta = pq.ParquetFile(raw).metadata
                    if meta.num_rows:
                        out.append((meta.row_group(0).column(0).statistics.min, info.path))
        return sorted(out)

    def _ids(self, n: int) -> np.ndarray:
        if self.held is None or self.held[0] != n:
            system, _ = _place(self.url)
            with system.open_input_file(self.files[n][1]) as raw:
                self.held = n, pq.ParquetFile(raw).read(columns=["id"])["id"].to_numpy()
            self.opened += 1
        return self.held[1]

    def __call__(self, cursor: str) -> list[dict]:
        if self.files is None:
            self.files = self._found()
        after = int(cursor) if cursor else None
        n = 0 if after is None else max(bisect_right(self.files, after, key=lambda f: f[0]) - 1, 0)
        out: list[int] = []
        while n < len(self.files) and len(out) < self.limit:
            ids = self._ids(n)
            k = 0 if after is None else int(np.searchsorted(ids, after, side="right"))
            out += ids[k : k + self.limit - len(out)].tolist()
            n += 1
        return [{"id": i} for i in out]


class Journal:
    """Pages by number in a folder, each written aside and moved to its name whole."""

    def __init__(self, url: str):
        self.system, path = _place(url)
        self.path = path.rstrip("/")
        self.system.create_dir(self.path, recursive=True)

    def last(self) -> int:
        """The number of the last page, 0 without any."""
        names = [f.base_name for f in self.system.get_file_info(fs.FileSelector(self.path))]
        return max((int(n) for n in names if n.isdigit()), default=0)

    def write(self, number: int, events: list[dict]) -> None:
        aside = f"{self.path}/.{uuid.uuid4().hex}"
        with self.system.open_output_stream(aside) as out:
            out.write(json.dumps(events, default=_coded).encode())
        self.system.move(aside, f"{self.path}/{number:012d}")

    def read(self, number: int) -> list[dict]:
        with self.system.open_input_stream(f"{self.path}/{number:012d}") as raw:
            text = raw.read()
        # Journals once had a line for each event.
        return json.loads(text) if text[:1] == b"[" else [json.loads(line) for line in text.splitlines()]

    def forget(self, before: int) -> None:
        for info in self.system.get_file_info(fs.FileSelector(self.path)):
            if info.base_name.isdigit() and int(info.base_name) < before:
                self.system.delete_file(info.path)


def _coded(value):
    """What JSON has no form for: bytes as hexadecimal digits, times as text with their zone."""
    if isinstance(value, (bytes, bytearray)):
        return value.hex()
    if isinstance(value, datetime):
        return value.astimezone(timezone.utc).isoformat()
    raise TypeError(type(value).__name__)


class Pages(InputPartition):
    """Pages from a number up to another, for one task."""

    def __init__(self, first: int, last: int):
        super().__init__(first)
        self.first, self.last = first, last


class PollReader(DataSourceStreamReader):
    """Options: journal (a shared folder), after, backoff (seconds), pages (in a micro-batch at most)."""

    def __init__(self, options, poll: Callable[[str], list[dict]], clock: Callable[[], float] = time.monotonic):
        self.journal, self.poll, self.clock = Journal(options["journal"]), poll, clock
        self.after, self.backoff, self.pages = options.get("after") or "", float(options.get("backoff") or BACKOFF), int(options.get("pages") or 10)
        self.page = self.journal.last()
        #: The id of the last event of that page; none: not looked up yet.
        self.cursor: str | None = None
        #: When the API may be asked again.
        self.again = 0.0

    def initialOffset(self) -> dict:  # noqa: N802
        return {"page": 0}

    def latestOffset(self) -> dict:  # noqa: N802
        for _ in range(self.pages):
            if self.clock() < self.again:
                break
            if self.cursor is None:
                self.cursor = str(self.journal.read(self.page)[-1]["id"]) if self.page else self.after
            events = self.poll(self.cursor)
            if not events:
                self.again = self.clock() + self.backoff
                break
            self.journal.write(self.page + 1, events)
            self.page, self.cursor = self.page + 1, str(events[-1]["id"])
        return {"page": self.page}

    def partitions(self, start: dict, end: dict) -> list[Pages]:
        first, last = start["page"] + 1, min(end["page"], self.journal.last())
        return [Pages(n, min(n + TASK - 1, last)) for n in range(first, last + 1, TASK)]

    def read(self, part: Pages) -> Iterator[pa.RecordBatch]:
        for number in range(part.first, part.last + 1):
            yield self._events(number)

    def _events(self, number: int) -> pa.RecordBatch:
        rows = self.journal.read(number)
        columns = {
            "id": pa.array([str(r["id"]) for r in rows], pa.string()), "type": pa.array([r.get("type", 0) for r in rows], pa.int32()), "foreign_id": pa.array([str(r.get("foreign_id", "")) for r in rows], pa.string()),
            "timestamp": pa.array([datetime.fromisoformat(r["timestamp"]) if r.get("timestamp") else None for r in rows], pa.timestamp("us", "UTC")),
            **{k: pa.array([bytes.fromhex(r[k]) if r.get(k) else None for r in rows], pa.binary()) for k in ("metadata", "trace")},
            # Numbered from 0.
            "page": pa.array([number - 1] * len(rows), pa.int64()),
        }
        return pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))

    def commit(self, end: dict) -> None:
        self.journal.forget(end["page"])


def live(spark: SparkSession, poll: Callable[[str], list[dict]], journal: str, **options) -> DataFrame:
    """The events of a poll function as a stream, with the number of their page; each is a dict with an
    id, and any of type, foreign_id, timestamp, metadata and trace. The function is sent to the process that plans the stream."""
    name = f"poll_{uuid.uuid4().hex}"
    parts = {"name": classmethod(lambda cls: name), "schema": lambda self: SCHEMA, "streamReader": lambda self, schema: PollReader(self.options, poll)}
    spark.dataSource.register(type("PollSource", (DataSource,), parts))
    return spark.readStream.format(name).options(journal=journal, **{k: str(v) for k, v in options.items()}).load()


def pages(events: DataFrame, limit: int) -> DataFrame:
    """(page, first_id, last_id, n): the pages that polling a log in steps of ``limit`` sees."""
    rows = with_position(events.select("id")).withColumn("page", F.floor((F.col("pos") - 1) / limit).cast("bigint"))
    return rows.groupBy("page").agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))
