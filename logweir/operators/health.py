"""How consumers are doing: lag, alerts, activity, histograms, counters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from logweir.functions.ages import age_seconds, at_most, lag_alert

#: Seconds of lag that raise an alert, and of silence after which a consumer counts as idle.
LAG_ALERT, ACTIVITY_TTL = 30 * 60.0, 24 * 3600.0
# Bounds in seconds of event age, time to consume, decoding and loading.
AGE_BUCKETS = (0.1, 0.5, 1, 5, 10, 50, 100, 500, 1_000, 10_000, 50_000, 100_000)
LATENCY_BUCKETS = (0.01, 0.1, 1, 5, 10, 60, 300)
DECODE_BUCKETS = (0.00001, 0.0001, 0.001, 0.01, 0.1, 1, 10)
LOAD_BUCKETS = (0.001, 0.01, 0.1, 1, 10, 60)


def consumer_health(consumed: DataFrame, now: Column, *, alert: float = LAG_ALERT, ttl: float = ACTIVITY_TTL) -> DataFrame:
    """Rows (consumer, id, timestamp, outcome) to one row a consumer."""
    lag = age_seconds(F.max("timestamp"), now)
    return consumed.groupBy("consumer").agg(
        F.count(F.lit(1)).alias("events"),
        F.max("id").alias("cursor"),
        F.count_if(F.col("outcome") == "skipped").alias("skipped"),
        F.count_if(F.col("outcome") == "failed").alias("errors"),
        F.round(lag, 3).alias("lag_seconds"),
        lag_alert(lag, alert).alias("lag_alert"),
        active(F.max("timestamp"), now, ttl).alias("active"),
    )


def active(last: Column, now: Column, ttl: float) -> Column:
    """1 within the time to live, else 0; null, not reported, if that is negative."""
    return F.when(age_seconds(last, now) < ttl, 1).otherwise(0) if ttl >= 0 else F.lit(None).cast("int")


def histogram(rows: DataFrame, value: Column, bounds: Sequence[float], *keys: str) -> DataFrame:
    """(keys, le, n) with cumulative counts; the last bound is infinity."""
    wide = rows.groupBy(*keys).agg(*[at_most(value, b).alias(f"b{i}") for i, b in enumerate([*bounds, float("inf")])])
    pairs = F.array(*[F.struct(F.lit(float(b)).alias("le"), F.col(f"b{i}").alias("n")) for i, b in enumerate([*bounds, float("inf")])])
    return wide.select(*keys, F.explode(pairs).alias("__x")).select(*keys, F.col("__x.le").alias("le"), F.col("__x.n").alias("n"))
