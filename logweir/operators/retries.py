"""Consumers that give up: best effort and dead letters; and the store of consumer errors.

An event that fails f times before it would succeed is tried least(f, retries) + 1 times. With
f <= retries it ends well; else the attempt after the last retry is swallowed, and the dead-letter
consumer records its error.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from logweir.operators.ordering import with_position
from logweir.schema import STATUS_RECORDED


def attempts(failures: Column, retries: int) -> Column:
    return (F.least(failures, F.lit(retries)) + 1).cast("bigint")


def gives_up(failures: Column, retries: int) -> Column:
    return failures > retries


def best_effort(events: DataFrame, failures: Column, retries: int) -> DataFrame:
    """Adds attempts, returned (errors passed on), and ignored."""
    return events.withColumns({"attempts": attempts(failures, retries), "returned": F.least(failures, F.lit(retries)).cast("bigint"), "ignored": gives_up(failures, retries)})


def dead_letters(events: DataFrame, failures: Column, retries: int, expected: Column | None = None) -> DataFrame:
    """Events whose error is recorded; expected errors are swallowed without a record."""
    return events.where(gives_up(failures, retries) & ~(F.lit(False) if expected is None else expected))


def recorded(calls: DataFrame, existing: DataFrame | None = None, first_id: int = 1) -> DataFrame:
    """Error rows for calls (seq, consumer, event_id, error_msg, at): one a consumer and event, with
    the first message; those that exist stay as they are."""
    first = Window.partitionBy("consumer", "event_id").orderBy("seq")
    rows = calls.withColumn("__k", F.row_number().over(first)).where("__k = 1").drop("__k")
    if existing is not None:
        rows = rows.join(existing.select("consumer", "event_id"), ["consumer", "event_id"], "left_anti")
    rows = with_position(rows, "seq", "__pos")
    return rows.select((F.col("__pos") + (first_id - 1)).alias("id"), "consumer", F.col("event_id").cast("string").alias("event_id"), "error_msg", F.col("at").alias("created_at"), F.col("at").alias("updated_at"), F.lit(STATUS_RECORDED).alias("error_status"))


def error_events(calls: DataFrame, errors: DataFrame, first_id: int = 1) -> DataFrame:
    """An event for every call, repeats too: foreign id the error row's, type the status."""
    known = errors.select(F.col("id").alias("__error"), F.col("consumer").alias("__consumer"), F.col("event_id").alias("__event"))
    rows = with_position(calls, "seq", "__pos").select("consumer", F.col("event_id").cast("string").alias("event_id"), "at", "__pos")
    rows = rows.join(known, (F.col("consumer") == F.col("__consumer")) & (F.col("event_id") == F.col("__event")))
    return rows.select((F.col("__pos") + (first_id - 1)).alias("id"), F.lit(STATUS_RECORDED).alias("type"), F.col("__error").cast("string").alias("foreign_id"), F.col("at").alias("timestamp"), F.encode("consumer", "UTF-8").alias("metadata"))
