"""The tables of a folder as logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.operators.log import EventLog

#: Event types by name; 0 is kept for placeholders.
TYPES = {"click": 1, "error": 2, "purchase": 3, "signup": 4, "view": 5}


def parquet(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def events(spark: SparkSession, folder: str) -> DataFrame:
    """The table ``events`` as a log: ids from 1, since 0 means before the first."""
    rows = parquet(spark, folder, "events")
    kind = F.lit(0)
    for name, code in TYPES.items():
        kind = F.when(F.col("event_type") == name, code).otherwise(kind)
    return rows.select(
        (F.col("event_id") + 1).alias("id"),
        kind.cast("int").alias("type"),
        F.col("user_id").cast("string").alias("foreign_id"),
        F.col("ts").cast("timestamp").alias("timestamp"),
        F.encode("props", "UTF-8").alias("metadata"),
        F.lit(None).cast("binary").alias("trace"),
    )


def event_log(folder: str, **options) -> EventLog:
    from logweir.schema import EventColumns

    return EventLog(lambda spark: events(spark, folder), EventColumns(metadata="metadata", trace="trace"), **options)
