"""How old events are, and histogram buckets."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def age_seconds(timestamp: Column, now: Column) -> Column:
    return (F.unix_micros(now.cast("timestamp")) - F.unix_micros(timestamp.cast("timestamp"))) / 1e6


def lag_alert(lag: Column, threshold: float) -> Column:
    """1 where the lag exceeds a positive threshold."""
    return (lag > threshold).cast("int") if threshold > 0 else F.lit(0)


def at_most(value: Column, bound: float) -> Column:
    """Cumulative bucket: how many values are at most the bound."""
    return F.count_if(value <= bound)
