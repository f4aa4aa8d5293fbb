"""Acknowledged and completed events."""

from __future__ import annotations

from collections import deque

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.operators.ordering import with_position, with_running_max


def ack_every(events: DataFrame, n: int) -> DataFrame:
    """(seq, cursor) of a consumer that acknowledges each n-th event."""
    rows = with_position(events.select("id")).where(F.col("pos") % n == 0)
    return rows.select((F.col("pos") / n).cast("bigint").alias("seq"), F.col("id").alias("cursor"))


def watermark(done: DataFrame) -> DataFrame:
    """(done_pos, watermark) after each completion: the last id with nothing before it outstanding.

    ``done`` has id and done_pos, the place of its completion. An event is ready when all up to it
    are done; the watermark is the last event that is ready."""
    ready = with_running_max(done.select("id", "done_pos"), "id", "done_pos", "ready")
    steps = ready.groupBy("ready").agg(F.max("id").alias("top"))
    every = done.select("done_pos").join(steps, F.col("done_pos") == F.col("ready"), "left").select("done_pos", F.coalesce("top", F.lit(0)).alias("top"))
    return with_running_max(every, "done_pos", "top", "watermark").select("done_pos", "watermark")


class Spans:
    """The same for a live consumer, over spans of ids that are at work side by side, begun in order.

    A span that fails is never done, so nothing behind it counts."""

    def __init__(self):
        #: Last id of each span that is not behind the watermark, and whether it is done.
        self.spans: deque[list] = deque()
        self.top: int | None = None

    def begin(self, last: int) -> list:
        span = [last, False]
        self.spans.append(span)
        return span

    def done(self, span: list) -> int | None:
        """The last id of the spans that are done with none before them outstanding."""
        span[1] = True
        while self.spans and self.spans[0][1]:
            self.top = self.spans.popleft()[0]
        return self.top
