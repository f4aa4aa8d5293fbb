"""Schemas of events, cursors and consumer errors, and configurable physical column names."""

from __future__ import annotations

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

EVENT = T.StructType([
    T.StructField("id", T.LongType(), False),
    T.StructField("type", T.IntegerType(), False),
    T.StructField("foreign_id", T.StringType(), False),
    T.StructField("timestamp", T.TimestampType(), False),
    T.StructField("metadata", T.BinaryType()),
    T.StructField("trace", T.BinaryType()),
])
CURSOR = T.StructType([
    T.StructField("consumer", T.StringType(), False),
    T.StructField("cursor", T.StringType(), False),
    T.StructField("updated_at", T.TimestampType(), False),
])
ERROR = T.StructType([
    T.StructField("id", T.LongType()),
    T.StructField("consumer", T.StringType()),
    T.StructField("event_id", T.StringType()),
    T.StructField("error_msg", T.StringType()),
    T.StructField("created_at", T.TimestampType()),
    T.StructField("updated_at", T.TimestampType()),
    T.StructField("error_status", T.IntegerType()),
])
#: Error statuses.
STATUS_UNKNOWN, STATUS_RECORDED = 0, 1


@dataclass(frozen=True)
class EventColumns:
    """Physical names of an event table; an empty name means that the column is not there."""

    id: str = "id"
    timestamp: str = "timestamp"
    type: str = "type"
    foreign_id: str = "foreign_id"
    metadata: str = ""
    trace: str = ""

    def renamed(self, **names: str) -> "EventColumns":
        return replace(self, **names)

    def read(self, table: DataFrame) -> DataFrame:
        """The table with canonical names; columns that are not there are null."""
        out = []
        for field in EVENT:
            name = getattr(self, field.name)
            column = F.col(f"`{name}`") if name else F.lit(None)
            out.append(column.cast(field.dataType).alias(field.name))
        return table.select(*out)

    def write(self, events: DataFrame) -> DataFrame:
        """Events with the table's own names."""
        return events.select(*[F.col(f.name).alias(getattr(self, f.name)) for f in EVENT if getattr(self, f.name)])


@dataclass(frozen=True)
class CursorColumns:
    consumer: str = "id"
    cursor: str = "last_event_id"
    updated_at: str = "updated_at"


@dataclass(frozen=True)
class ErrorColumns:
    id: str = "id"
    consumer: str = "consumer"
    event_id: str = "event_id"
    error_msg: str = "error_msg"
    created_at: str = "created_at"
    updated_at: str = "updated_at"
    error_status: str = "error_status"

    def write(self, errors: DataFrame) -> DataFrame:
        return errors.withColumnsRenamed({f.name: getattr(self, f.name) for f in ERROR if f.name in errors.columns})
