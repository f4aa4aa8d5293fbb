"""Event filters, also filters that can fail.

A filter's outcome is a struct (ok, err). Filters combine by the rules of short-circuit evaluation:
all: the first that is false or fails decides; any: the first that is true decides, else the last
error, if there was one.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def is_any_type(*types: int) -> Column:
    """Without types, no event."""
    return F.col("type").isin(*types) if types else F.lit(False)


def include_types(events: DataFrame, types: Sequence[int] = ()) -> DataFrame:
    """Without types, all events."""
    return events.where(F.col("type").isin(*types)) if types else events


def outcome(ok: Column, err: Column | None = None) -> Column:
    return F.struct(F.coalesce(ok, F.lit(False)).alias("ok"), (F.lit(None) if err is None else err).cast("string").alias("err"))


def all_filters(*filters: Column) -> Column:
    if not filters:
        return outcome(F.lit(True))
    decisive = F.filter(F.array(*filters), lambda f: ~f["ok"] | f["err"].isNotNull())
    return F.coalesce(F.try_element_at(decisive, F.lit(1)), outcome(F.lit(True)))


def any_filters(*filters: Column) -> Column:
    if not filters:
        return outcome(F.lit(False))
    every = F.array(*filters)
    hit = F.exists(every, lambda f: f["ok"] & f["err"].isNull())
    failed = F.filter(every, lambda f: f["err"].isNotNull())
    return F.when(hit, outcome(F.lit(True))).otherwise(outcome(F.lit(False), F.try_element_at(failed, F.lit(-1))["err"]))


def metadata_filter(schema: str, test, *, column: str = "metadata") -> Column:
    """Decodes JSON metadata to a schema, then tests it; undecodable metadata is an error."""
    text = F.col(column).cast("string")
    broken = text.isNotNull() & F.try_parse_json(text).isNull()
    return outcome(~broken & F.coalesce(test(F.from_json(text, schema)), F.lit(False)), F.when(broken, F.lit("metadata cannot be decoded")))


def consumer_outcome(types: Sequence[int], event_filter: Column | None = None) -> Column:
    """What a consumer does with an event: skipped, failed or processed. The type goes first, and a
    type that is not asked for never reaches the filter."""
    out = F.lit("processed")
    if event_filter is not None:
        out = F.when(event_filter["err"].isNotNull(), "failed").when(~event_filter["ok"], "skipped").otherwise(out)
    return F.when(~F.col("type").isin(*types), "skipped").otherwise(out) if types else out
