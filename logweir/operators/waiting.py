"""Starting points and awaited events."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def bootstrap(cursors: DataFrame, head: DataFrame) -> DataFrame:
    """(consumer, after, from_head): a consumer without a cursor starts at the head."""
    none = F.coalesce(F.col("cursor"), F.lit("")) == ""
    return cursors.select("consumer", F.when(none, head.scalar()).otherwise(F.col("cursor").try_cast("bigint")).alias("after"), none.alias("from_head"))


def awaited(events: DataFrame, head: int, foreign_id: str | Column, types: Sequence[int]) -> DataFrame:
    """The first event behind a head for an entity, of one of some types."""
    rows = events.where((F.col("id") > head) & (F.col("foreign_id") == foreign_id) & F.col("type").isin(*types))
    return rows.orderBy("id").limit(1)
