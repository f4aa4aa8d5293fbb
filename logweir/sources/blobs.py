"""Blob logs: files in key order, each a run of records, as one log.

An event's id is its cursor: key|LL|offset, or key|eof for the last record of a blob. Records are
JSON values written one after the other, with or without white space between them; another decoder
may be given. A decoder reads its blob in parts, so a blob never has to fit in memory.

``bloblog`` is a data source for batches and streams. Its offset is the cursor. Keys are listed in
order from behind the last one: folders that lie before it are not entered, so what a look costs follows
the new blobs and the folders that hold them. A micro-batch has at most so many blobs, dealt to tasks by
size; a cursor in mid-blob skips the records before it in the task that reads the blob.

Paths may be on any file system that pyarrow knows by URL: local, HDFS, S3, GCS.
"""

from __future__ import annotations

import codecs
import io
import json
import re
import time
import uuid
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from logweir.errors import CursorAtEnd, CursorOutOfRange, LogError, Stopped
from logweir.functions import blobs as cursors
from logweir.options import StreamOptions
from logweir.storage import delete, shared_dir

#: Bytes that a decoder takes at once, records of a batch, bytes of blobs in one task, blobs in a micro-batch.
PART, RECORDS, TASK, MOST = 1 << 20, 1000, 16 << 20, 10_000
#: Seconds between two listings.
BACKOFF = 60.0
Decoder = Callable[[io.BufferedIOBase], Iterable[bytes]]
#: White space between values.
_GAP = re.compile(r"[ \t\r\n]*")


def json_values(blob: bytes | io.BufferedIOBase) -> Iterator[bytes]:
    """The JSON values of a blob, as they are written; only the value at hand is kept."""
    stream = io.BytesIO(blob) if isinstance(blob, bytes) else blob
    utf8, parse = codecs.getincrementaldecoder("utf-8")(), json.JSONDecoder().raw_decode
    # The values before ``at`` are given out; what is left of a part is moved once, with the next.
    text, at, ended, want = "", 0, False, 0
    while True:
        at = _GAP.match(text, at).end()
        if at < len(text) and (ended or len(text) - at >= want):
            try:
                _, end = parse(text, at)
            except json.JSONDecodeError:
                if ended:
                    raise
                # A value that is cut is tried again when there is twice as much of it.
                want = 2 * (len(text) - at)
            else:
                # A number may go on behind the part.
                if ended or text[end - 1] in "]}\"" or end < len(text) and text[end] not in "+-.eE":
                    yield text[at:end].encode()
                    at, want = end, 0
                    continue
                want = len(text) - at + 1
        elif ended:
            return
        part = stream.read(PART)
        ended = not part
        text, at = text[at:] + utf8.decode(part, final=ended), 0


class MissingBucket(LogError):
    """A bucket that is not there."""


def _place(url: str) -> tuple[fs.FileSystem, str]:
    system, path = fs.FileSystem.from_uri(url) if "://" in url else (fs.LocalFileSystem(), url.removeprefix("file:"))
    return system, path.rstrip("/")


@dataclass
class Listing:
    """Keys of a bucket in order; names that begin with a dot are the file system's own. ``looks`` counts
    the folders that were listed."""

    url: str
    prefix: str = ""
    looks: int = 0

    def check(self) -> tuple[fs.FileSystem, str]:
        system, root = _place(self.url)
        if system.get_file_info(root).type != fs.FileType.Directory:
            raise MissingBucket(self.url)
        return system, root

    def behind(self, key: str, including: bool = False) -> Iterator[tuple[str, int]]:
        """(key, size) of the blobs behind a key, or from it on, one folder at a time."""
        system, root = self.check()

        def walk(folder: str) -> Iterator[tuple[str, int]]:
            self.looks += 1
            found = []
            for info in system.get_file_info(fs.FileSelector(f"{root}/{folder}" if folder else root)):
                if info.base_name.startswith("."):
                    continue
                name = f"{folder}{info.base_name}"
                found.append((f"{name}/" if info.type == fs.FileType.Directory else name, info.size))
            # A folder sorts as its keys do: by its name with the slash.
            for name, size in sorted(found):
                if name.endswith("/"):
                    before = name < key[: len(name)] or not (name.startswith(self.prefix) or self.prefix.startswith(name))
                    if not before:
                        yield from walk(name)
                elif name.startswith(self.prefix) and (name > key or including and name == key):
                    yield name, size

        return walk("")


@dataclass
class Blobs(InputPartition):
    """Blobs for one task; of the first, ``skip`` records are passed over."""

    keys: list[str]
    skip: int = 0
    #: The key that a cursor in mid-blob names: it must have more records.
    mid: str = ""
    value: int = field(default=0)


SCHEMA = "id string, type int, foreign_id string, timestamp timestamp, metadata binary, trace binary"
_TYPES = [("id", pa.string()), ("type", pa.int32()), ("foreign_id", pa.string()), ("timestamp", pa.timestamp("us", "UTC")), ("metadata", pa.binary()), ("trace", pa.binary())]


class _Reader:
    def __init__(self, options, decoder: Decoder):
        self.listing, self.decoder = Listing(options["url"].rstrip("/"), options.get("prefix") or ""), decoder
        self.after, self.most = options.get("after") or "", int(options.get("maxBlobs") or MOST)
        self.task = int(options.get("taskBytes") or TASK)

    def _begin(self, cursor: str) -> Iterator[tuple[str, int]]:
        key, _, eof = cursors.order_of(cursor)
        return self.listing.behind(key, including=not eof)

    def dealt(self, blobs: Iterable[tuple[str, int]], cursor: str) -> list[Blobs]:
        key, offset, eof = cursors.order_of(cursor)
        parts, held = [], 0
        for name, size in blobs:
            mid = not eof and offset is not None and name == key
            if not parts or held + size > self.task or mid:
                parts.append(Blobs([], offset + 1 if mid else 0, name if mid else ""))
                held = 0
            parts[-1].keys.append(name)
            held += size
        return parts

    def read(self, part: Blobs) -> Iterator[pa.RecordBatch]:
        system, root = _place(self.listing.url)
        for n, key in enumerate(part.keys):
            at = system.get_file_info(f"{root}/{key}").mtime
            rows, skip = [], part.skip if n == 0 else 0
            with system.open_input_stream(f"{root}/{key}") as stream:
                # One record is held back: whether it is the last is known with the next.
                count, held = 0, None
                for record in self.decoder(stream):
                    if held is not None and count > skip:
                        rows.append((cursors.rendered(key, count - 1, False), held))
                    held, count = record, count + 1
                    if len(rows) == RECORDS:
                        yield self._batch(rows, at)
                        rows = []
            if key == part.mid and skip >= count:
                raise (CursorAtEnd if skip == count else CursorOutOfRange)(f"{key}: {skip - 1}")
            if held is not None:
                rows.append((cursors.rendered(key, count - 1, True), held))
            if rows:
                yield self._batch(rows, at)

    def _batch(self, rows: list[tuple[str, bytes]], at) -> pa.RecordBatch:
        n = len(rows)
        columns = [[i for i, _ in rows], [0] * n, [""] * n, [at] * n, [r for _, r in rows], [None] * n]
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, _TYPES, strict=True)], names=[k for k, _ in _TYPES])


class BlobReader(_Reader, DataSourceReader):
    def partitions(self) -> list[Blobs]:
        return self.dealt(self._begin(self.after), self.after) or [Blobs([])]


class BlobStreamReader(_Reader, DataSourceStreamReader):
    """Offsets are cursors; those between micro-batches are ends of blobs."""

    def __init__(self, options, decoder: Decoder):
        super().__init__(options, decoder)
        self.end: str | None = None
        #: What was listed and is not yet planned.
        self.seen: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {"cursor": self.after}

    def latestOffset(self) -> dict:  # noqa: N802
        if self.end is None:
            self.end = self.after
        for n, (key, size) in enumerate(self._begin(self.end), 1):
            self.seen[key] = size
            self.end = cursors.rendered(key, 0, True)
            if n == self.most:
                break
        return {"cursor": self.end}

    def partitions(self, start: dict, end: dict) -> list[Blobs]:
        first, (last, _, _) = cursors.order_of(start["cursor"]), cursors.order_of(end["cursor"])
        known = sorted(k for k in self.seen if k <= last and (k > first[0] or k == first[0] and not first[2]))
        if last not in self.seen:
            # After a restart nothing is known of the offsets that were planned before it.
            blobs = []
            for key, size in self._begin(start["cursor"]):
                if key > last:
                    break
                blobs.append((key, size))
        else:
            blobs = [(k, self.seen[k]) for k in known]
        return self.dealt(blobs, start["cursor"])

    def commit(self, end: dict) -> None:
        last = cursors.order_of(end["cursor"])[0]
        self.seen = {k: size for k, size in self.seen.items() if k > last}


class BlobSource(DataSource):
    """Options: url, prefix, after (a cursor), maxBlobs (in a micro-batch), taskBytes."""

    decoder: Decoder = staticmethod(json_values)

    @classmethod
    def name(cls) -> str:
        return "bloblog"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema):
        return BlobReader(self.options, self.decoder)

    def streamReader(self, schema):  # noqa: N802
        return BlobStreamReader(self.options, self.decoder)


def _ordered(rows: DataFrame) -> DataFrame:
    """Rows in order of their cursors, which are taken apart once a row and not in each comparison."""
    return rows.withColumn("__at", cursors.order(F.col("id"))).orderBy("__at.key", "__at.eof", "__at.offset").drop("__at")


class Bucket:
    """A folder of blobs. After ``close`` nothing is read."""

    def __init__(self, url: str, prefix: str = "", decoder: Decoder = json_values):
        self.url, self.prefix, self.decoder = url.rstrip("/"), prefix, decoder
        self.closed = False

    def close(self) -> None:
        self.closed = True

    def keys(self, after: str = "") -> Iterator[str]:
        """Keys behind a key, in order."""
        return (key for key, _ in Listing(self.url, self.prefix).behind(after))

    def _format(self, spark: SparkSession) -> str:
        if self.closed:
            raise Stopped(self.url)
        Listing(self.url).check()
        if self.decoder is json_values:
            source = BlobSource
        else:
            name, decoder = f"bloblog_{uuid.uuid4().hex}", self.decoder
            source = type("OwnBlobSource", (BlobSource,), {"decoder": staticmethod(decoder), "name": classmethod(lambda cls: name)})
        spark.dataSource.register(source)
        return source.name()

    def _options(self, cursor: str, options: StreamOptions | None) -> dict[str, str]:
        if options is not None and options != StreamOptions():
            raise LogError("blob streams take no options")
        cursors.order_of(cursor)
        return {"url": self.url, "prefix": self.prefix, "after": cursor}

    def stream(self, spark: SparkSession, cursor: str = "", options: StreamOptions | None = None) -> DataFrame:
        """Events behind a cursor, in order: id, type 0, no foreign id, the blob's time, the record."""
        options_ = self._options(cursor, options)
        rows = spark.read.format(self._format(spark)).options(**options_).load()
        return _ordered(rows).select("id", "type", "foreign_id", "timestamp", "metadata", "trace")

    def live(self, spark: SparkSession, cursor: str = "", **options: str) -> DataFrame:
        """The same as a stream that goes on with blobs that come; its order is that of ``functions.blobs.order``."""
        return spark.readStream.format(self._format(spark)).options(**self._options(cursor, None), **options).load()

    def follow(self, spark: SparkSession, consume: Callable[[DataFrame], None], store, name: str, *, checkpoint: str | None = None, backoff: float = BACKOFF, sleep: Callable[[float], None] = time.sleep, rounds: int | None = None, metrics=None, **options: str) -> None:
        """Hands over what lies behind a consumer's cursor, a micro-batch at a time, and sets it to the last
        record of each; at the end of the bucket it waits and looks again.

        The cursor is all that is remembered; a store that only goes forward compares cursors by
        ``functions.blobs.rank_of``, in the order of keys. Ends with ``Stopped`` once the bucket is closed."""
        place = checkpoint or f"{shared_dir(spark)}/blobs-{uuid.uuid4().hex}"

        def step(batch: DataFrame, _: int) -> None:
            batch = batch.persist()
            try:
                last = batch.agg(F.max_by("id", cursors.order(F.col("id"))).alias("id"), F.count(F.lit(1)).alias("n")).first()
                if metrics:
                    metrics.add("decoded_rows", name, last["n"])
                if last["n"]:
                    consume(_ordered(batch))
                    store.set(name, last["id"])
                    store.flush()
            finally:
                batch.unpersist()

        done = 0
        while rounds is None or done < rounds:
            at = f"{place}/{uuid.uuid4().hex}"
            try:
                query = self.live(spark, store.get(name), **options).writeStream.foreachBatch(step).option("checkpointLocation", at).trigger(processingTime="0 seconds").start()
                try:
                    query.processAllAvailable()
                finally:
                    query.stop()
                if metrics:
                    metrics.add("blobs_listed", name)
            except Exception:
                if metrics:
                    metrics.add("blob_errors", name)
                raise
            finally:
                delete(spark, at)
            done += 1
            if rounds is None or done < rounds:
                sleep(backoff)
