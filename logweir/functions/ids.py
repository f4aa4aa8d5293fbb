"""Identifiers as integers, and the shard hash."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

_INTEGER = "^[+-]?[0-9]+$"
MAX, MIN = (1 << 63) - 1, -(1 << 63)


def is_int(text: Column) -> Column:
    """A sign and digits only, within 64 bits."""
    return F.coalesce(text.rlike(_INTEGER) & text.try_cast("bigint").isNotNull(), F.lit(False))


def to_int(text: Column) -> Column:
    """The integer; 0 where there is none; the nearest end of the range where it does not fit."""
    # A number that does not fit is one of sign and digits only; a cast alone would also take blanks.
    edge = F.when(F.coalesce(~text.rlike(_INTEGER), F.lit(True)), 0).when(text.startswith("-"), F.lit(MIN)).otherwise(F.lit(MAX))
    plain = F.when(~text.rlike("[^0-9+-]"), text.try_cast("bigint"))
    return F.coalesce(plain, edge, F.lit(0)).cast("bigint")


def from_int(number: Column) -> Column:
    return number.cast("string")


# Fixed values of the 32-bit FNV-1 hash: offset basis and prime.
FNV_BASIS, FNV_PRIME = 2166136261, 16777619


def fnv1_32(text: Column) -> Column:
    """FNV-1 (multiply, then xor) of the UTF-8 bytes. Products stay below 2**57."""
    pairs = F.filter(F.split(F.hex(F.encode(text, "UTF-8")), "(?<=\\G..)"), lambda x: x != "")
    step = lambda h, x: (h * F.lit(FNV_PRIME)).bitwiseAND(F.lit(0xFFFFFFFF)).bitwiseXOR(F.conv(x, 16, 10).cast("bigint"))
    return F.aggregate(pairs, F.lit(FNV_BASIS).cast("bigint"), step)
