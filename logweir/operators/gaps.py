"""Holes in a log's ids: found, reported, filled.

Detection never windows the whole log in one task: see ``ordering.with_previous``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.operators.log import LAST, after
from logweir.operators.ordering import with_previous


def _holes(events: DataFrame, cursor: int = 0) -> DataFrame:
    """The event behind each hole, with ``prev``, the id before it."""
    rows = with_previous(after(events, cursor))
    if cursor:
        rows = rows.withColumn("prev", F.coalesce("prev", F.lit(cursor)))
    return rows.where(F.col("prev").isNotNull() & (F.col("id") != F.col("prev") + 1))


def gaps(events: DataFrame, cursor: int = 0) -> DataFrame:
    """(prev, next) around each hole behind a cursor. From the empty cursor, a log may start at any id."""
    return _holes(events.select("id"), cursor).select("prev", F.col("id").alias("next"))


def contiguous(events: DataFrame, cursor: int = 0) -> DataFrame:
    """Events behind a cursor up to the first hole; what lies beyond is withheld."""
    first = gaps(events, cursor).agg(F.coalesce(F.min("next"), F.lit(LAST)))
    return after(events, cursor).where(F.col("id") < first.scalar())


def missing(events: DataFrame, cursor: int = 0) -> DataFrame:
    """The ids in holes."""
    return gaps(events, cursor).select(F.explode(F.sequence(F.col("prev") + 1, F.col("next") - 1)).alias("id"))


def _fillers(events: DataFrame, holes: DataFrame, older_than=None) -> DataFrame:
    """A no-op event for each id in holes (prev, next, timestamp)."""
    if older_than is not None:
        holes = holes.where(F.col("timestamp") < older_than)
    rows = holes.select(F.explode(F.sequence(F.col("prev") + 1, F.col("next") - 1)).alias("id"), "timestamp")
    fill = {"id": F.col("id"), "type": F.lit(0), "foreign_id": F.lit("0"), "timestamp": F.col("timestamp")}
    return rows.select(*[fill.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in events.schema])


def fillers(events: DataFrame, holes: DataFrame, *, older_than=None) -> DataFrame:
    """No-op events for holes (prev, next) that the log does not hold by now."""
    timed = holes.join(events.select(F.col("id").alias("next"), "timestamp"), "next")
    return _fillers(events, timed, older_than).join(events.select("id"), "id", "left_anti").select(*events.columns)


def filled(events: DataFrame, cursor: int = 0, *, older_than=None) -> DataFrame:
    """The log with a no-op event in each hole, stamped with the time of the event after it.

    ``older_than`` (a timestamp column) leaves holes open whose next event is younger: their rows may
    be on their way. The log itself is not changed."""
    holes = _holes(events.select("id", "timestamp"), cursor).select("prev", F.col("id").alias("next"), "timestamp")
    return events.unionByName(_fillers(events, holes, older_than))
