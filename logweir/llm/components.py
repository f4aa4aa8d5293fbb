"""Connected components of a link table, by alternating large and small stars.

Every round sends each node's neighbours to its smallest neighbour: two aggregations, which combine
before their exchange, and two equi-joins, which adaptive execution splits where a node is a hub.
The table ends as stars around the smallest member; the rounds grow with the logarithm of its
longest chain. No task and no driver holds a component.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import Scratch


def components(links: DataFrame, scratch: Scratch) -> DataFrame:
    """From rows (a, b) of linked nodes: (node, component) for each node that has a smaller one."""
    stars = scratch.write(links.select(F.least("a", "b").alias("lo"), F.greatest("a", "b").alias("hi")).where("lo < hi").distinct())
    state = None
    while True:
        both = stars.select(F.col("lo").alias("u"), F.col("hi").alias("v")).union(stars.select("hi", "lo"))
        # Written out, the aggregate has no partitioning that the join must keep, so hubs can be split.
        least = scratch.write(both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m")))
        large = scratch.write(both.join(least, "u").where("v > u").select(F.col("m").alias("lo"), F.col("v").alias("hi")).distinct())
        lowest = scratch.write(large.groupBy("hi").agg(F.min("lo").alias("m")))
        small = large.join(lowest, "hi").select(F.col("m").alias("lo"), F.col("lo").alias("hi")).where("lo < hi")
        following = scratch.write(small.union(lowest.select(F.col("m").alias("lo"), "hi")).distinct())
        found = following.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("lo", "hi").cast("decimal(38,0)")).alias("h")).first()
        for old in (stars, least, large, lowest):
            scratch.drop(old)
        stars = following
        if state == tuple(found):
            return stars.select(F.col("hi").alias("node"), F.col("lo").alias("component"))
        state = tuple(found)
