"""Hash-sharded consumption: one scan gives every event its shard.

Each of n consumers keeps the events whose hash falls to it; a cluster reads the log once, derives
the shard as a column and partitions by it.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions.ids import fnv1_32

BY_ID, BY_TYPE, BY_FOREIGN_ID = "id", "type", "foreign_id"


def shard(n: int, by: str | Column = BY_ID) -> Column:
    """The shard of an event, 1..n."""
    key = F.col(by) if isinstance(by, str) else by
    return (fnv1_32(key.cast("string")) % n + 1).cast("int")


def shard_name(base: Column, number: Column, n: int) -> Column:
    return F.concat(base, F.lit("_"), number.cast("string"), F.lit(f"_of_{n}"))


def shard_names(base: str, n: int, formatter: Callable[[str, int, int], str] | None = None) -> list[str]:
    return [formatter(base, m, n) if formatter else f"{base}_{m + 1}_of_{n}" for m in range(n)]


def with_shards(events: DataFrame, n: int, by: str | Column = BY_ID) -> DataFrame:
    return events.withColumn("shard", shard(n, by))


def parallel(events: DataFrame, n: int, by: str | Column = BY_ID) -> DataFrame:
    """Events dealt to n partitions by shard, each in order of ids."""
    return with_shards(events, n, by).repartitionByRange(n, "shard").sortWithinPartitions("shard", "id")


def names_table(spark: SparkSession, base: str, n: int) -> DataFrame:
    number = F.col("id") + 1
    return spark.range(n).select(number.cast("int").alias("shard"), shard_name(F.lit(base), number, n).alias("name"))
