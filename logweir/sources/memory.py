"""Logs for tests: a list that grows, and files dropped into a folder."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession

from logweir.errors import HeadReached, Stopped
from logweir.options import StreamOptions
from logweir.schema import EVENT


class MemoryLog:
    """An appendable log; cursors are ids."""

    def __init__(self):
        self.rows: list[tuple] = []
        self.stopped = False

    def insert(self, foreign_id: str, type_: int, metadata: bytes | None = None, at: datetime | None = None) -> int:
        self.rows.append((len(self.rows) + 1, type_, foreign_id, at or datetime.now(timezone.utc), metadata, None))
        return len(self.rows)

    def stop(self) -> None:
        self.stopped = True

    def frame(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame(self.rows, EVENT)

    def stream(self, after: str = "", options: StreamOptions = StreamOptions()):
        """Events in order. Ends with HeadReached where asked to; from_head counts at opening, and
        only without a cursor."""
        at = len(self.rows) if options.from_head and not after else int(after or 0)
        while True:
            if self.stopped:
                raise Stopped
            if at >= len(self.rows):
                raise HeadReached
            at += 1
            yield self.rows[at - 1]

    def append_file(self, spark: SparkSession, folder: str, start: int = 0) -> None:
        """Writes the rows from ``start`` on as one more file of a log table."""
        spark.createDataFrame(self.rows[start:], EVENT).coalesce(1).write.mode("append").parquet(folder)
