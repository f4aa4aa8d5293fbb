"""The event log: pages, head, lag, no-op events, and inserts."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, replace

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.errors import InvalidEvent, NotIncreasing
from logweir.operators.ordering import with_position
from logweir.schema import EVENT, EventColumns

#: Events in a page, and what a limit of 0 or less stands for.
PAGE = 1000
#: Behind every id.
LAST = (1 << 63) - 1


def is_noop(foreign_id: Column | None = None, type_: Column | None = None) -> Column:
    """A placeholder event: foreign id "0" and type 0, both."""
    foreign_id = F.col("foreign_id") if foreign_id is None else foreign_id
    type_ = F.col("type") if type_ is None else type_
    return (foreign_id == "0") & (type_ == 0)


def after(events: DataFrame, cursor: int) -> DataFrame:
    """Events behind a cursor; 0 is before the first."""
    return events.where(F.col("id") > cursor)


def page(events: DataFrame, cursor: int, limit: int = PAGE) -> DataFrame:
    """The next events behind a cursor, in order."""
    return after(events, cursor).orderBy("id").limit(limit if limit > 0 else PAGE)


def head(events: DataFrame) -> DataFrame:
    """The last id, as one row; 0 for an empty log."""
    return events.agg(F.coalesce(F.max("id"), F.lit(0)).cast("bigint").alias("head"))


def head_id(events: DataFrame) -> int:
    return int(head(events).first()[0])


def without_noops(events: DataFrame) -> DataFrame:
    return events.where(~is_noop())


def page_with_override(events: DataFrame, cursor: int, limit: int = PAGE) -> DataFrame:
    """One row for a page: events returned, events dropped as no-ops, and the cursor to go on from.

    The cursor moves past no-ops, also where a page holds nothing else."""
    rows = page(events, cursor, limit)
    return rows.agg(F.count_if(~is_noop()).alias("returned"), F.count_if(is_noop()).alias("dropped"), F.coalesce(F.max("id"), F.lit(cursor)).cast("bigint").alias("next_cursor"))


def lagged(events: DataFrame, now: Column, lag: Column) -> DataFrame:
    """Events older than the lag; one of just that age is held back."""
    return events.where(F.col("timestamp") < now - lag)


def lagged_prefix(events: DataFrame, now: Column, lag: Column) -> DataFrame:
    """Events before the first that is too new, as a live stream delivers them; just that age passes."""
    young = events.where(F.col("timestamp") > now - lag).agg(F.coalesce(F.min("id"), F.lit(LAST)))
    return events.where(F.col("id") < young.scalar())


def checked_increasing(events: DataFrame) -> DataFrame:
    """The events as they come; fails on an id that does not rise above the one before it.

    Each partition checks its own order where it lies; what is left is one row a partition, its first
    and last id, for the steps from one partition to the next."""
    rows = events.withColumn("__part", F.spark_partition_id())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            ids = batch.column(batch.schema.get_field_index("id"))
            if len(ids):
                before = pa.concat_arrays([pa.array([last], ids.type), ids[:-1]])
                if pc.any(pc.less_equal(ids, before)).as_py():
                    raise NotIncreasing("event ids do not increase")
                last = ids[-1].as_py()
            yield batch

    def order(row: Column) -> Column:
        return F.max(row).over(Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1))

    edges = rows.groupBy("__part").agg(F.min("id").alias("__lo"), F.max("id").alias("__hi"))
    bad = edges.select((F.col("__lo") <= order(F.col("__hi"))).alias("bad")).agg(F.coalesce(F.bool_or("bad"), F.lit(False)))
    checked = events.mapInArrow(run, events.schema)
    return checked.where(~bad.scalar() | F.raise_error(F.lit("event ids do not increase")).isNull())


@dataclass(frozen=True)
class EventLog:
    """A log over any provider of a table, with its column names and page size."""

    provider: Callable[[SparkSession], DataFrame]
    columns: EventColumns = EventColumns()
    limit: int = PAGE
    include_noops: bool = False

    def clone(self, **changes) -> "EventLog":
        return replace(self, **changes)

    def events(self, spark: SparkSession) -> DataFrame:
        return self.columns.read(self.provider(spark))

    def stream(self, spark: SparkSession, cursor: int = 0) -> DataFrame:
        """All events behind a cursor, in order, without no-ops unless they are asked for."""
        rows = after(self.events(spark), cursor)
        return (rows if self.include_noops else without_noops(rows)).orderBy("id")

    def page(self, spark: SparkSession, cursor: int = 0) -> DataFrame:
        rows = page(self.events(spark), cursor, self.limit)
        return rows if self.include_noops else without_noops(rows)


def new_events(spark: SparkSession, rows: DataFrame, head_: int, columns: EventColumns = EventColumns(), now: Column | None = None) -> DataFrame:
    """Rows (foreign_id, type, optional metadata and trace, and an integer ``seq``) as events to
    append behind the head, in order of seq. No-ops and metadata without a column for it fail."""
    if "metadata" in rows.columns and not columns.metadata:
        raise InvalidEvent("metadata not enabled")
    stamped = with_position(rows, "seq", "__pos").withColumns({"id": F.col("__pos") + head_, "timestamp": F.current_timestamp() if now is None else now})
    fail = F.raise_error(F.lit("a no-op event may not be inserted"))
    stamped = stamped.withColumn("foreign_id", F.when(is_noop(F.col("foreign_id").cast("string"), F.col("type")), fail.cast("string")).otherwise(F.col("foreign_id").cast("string")))
    return stamped.select(*[(F.col(f.name) if f.name in stamped.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in EVENT])
