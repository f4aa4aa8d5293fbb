"""Positions and running values along the whole log, without one task that holds it.

A window over the whole log would sort it in a single task. Here a key's bits make a tree: rows that
agree in all but the last 20 bits are a bucket, buckets that agree in all but the next 22 are one of the
next level. Each bucket is windowed alone; the value of the rows before it comes from the level above, where
it is one row. So a window has at most a million rows of the log, or four million rows of two numbers
that stand for a bucket each, however dense or sparse the keys are, up to the top with its 22 bits. More
levels would bound them more tightly, at the cost of stages that most logs do not need.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Bits of the key that each level takes off.
SHIFTS = (20, 22)
_BEFORE = (Window.unboundedPreceding, -1)


def _add(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def _carried(cells: DataFrame, fold: Callable, both: Callable, shifts: Sequence[int]) -> DataFrame:
    """(__k, __before): what the cells (__k, __v) with smaller keys fold to, null for none."""
    if not shifts:
        return cells.select("__k", fold("__v").over(Window.orderBy("__k").rowsBetween(*_BEFORE)).alias("__before"))
    # One exchange serves the window and the level above.
    rows = cells.withColumn("__g", F.shiftright("__k", shifts[0])).repartition("__g")
    inside = fold("__v").over(Window.partitionBy("__g").orderBy("__k").rowsBetween(*_BEFORE))
    above = _carried(rows.groupBy(F.col("__g").alias("__k")).agg(fold("__v").alias("__v")), fold, both, shifts[1:])
    rows = rows.withColumn("__in", inside).join(above.select(F.col("__k").alias("__g"), F.col("__before").alias("__out")), "__g")
    return rows.select("__k", both(F.col("__in"), F.col("__out")).alias("__before"))


def _with_bucket(rows: DataFrame, key: str, value: Column, fold: Callable, both: Callable, own: Callable, shifts: Sequence[int]) -> DataFrame:
    """``rows`` with __own, ``own`` over the bucket's window in order of the key, and __before, what the
    buckets before fold to."""
    rows = rows.withColumn("__k", F.shiftright(F.col(key).cast("bigint"), shifts[0]))
    cells = rows.groupBy("__k").agg(fold(value).alias("__v"))
    return rows.withColumn("__own", own(Window.partitionBy("__k").orderBy(key))).join(_carried(cells, fold, both, shifts[1:]), "__k").drop("__k")


def with_position(rows: DataFrame, key: str = "id", name: str = "pos", *, shifts: Sequence[int] = SHIFTS) -> DataFrame:
    """Adds the row number, from 1, in order of an integer key without ties."""
    out = _with_bucket(rows, key, F.lit(1), F.sum, _add, lambda w: F.row_number().over(w), shifts)
    return out.withColumn(name, _add(F.col("__own"), F.col("__before")).cast("bigint")).drop("__own", "__before")


def with_running_max(rows: DataFrame, key: str, value: str, name: str, *, shifts: Sequence[int] = SHIFTS) -> DataFrame:
    """Adds the maximum of ``value`` over all rows up to and including this one by ``key``."""
    out = _with_bucket(rows, key, F.col(value), F.max, F.greatest, lambda w: F.max(value).over(w.rowsBetween(Window.unboundedPreceding, 0)), shifts)
    return out.withColumn(name, F.greatest("__own", "__before")).drop("__own", "__before")


def with_previous(rows: DataFrame, key: str = "id", name: str = "prev", *, shifts: Sequence[int] = SHIFTS) -> DataFrame:
    """Adds the key of the row before; null at the start."""
    out = _with_bucket(rows, key, F.col(key), F.max, F.greatest, lambda w: F.lag(key).over(w), shifts)
    return out.withColumn(name, F.coalesce("__own", "__before")).drop("__own", "__before")
