"""Cursors of blob logs: key, record offset, end mark.

The text of cursors of one blob sorts as they do. Across blobs their order is that of the keys, which
``order`` gives: where one key begins with another, text may sort otherwise."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from logweir.errors import LogError

#: What stands for the end of a blob.
END = "eof"


def render(key: Column, offset: Column, at_end: Column) -> Column:
    """key|LL|offset, LL being the two-digit length of the offset, or key|eof."""
    digits = offset.cast("string")
    return F.when(at_end, F.concat(key, F.lit("|" + END))).otherwise(F.concat_ws("|", key, F.lpad(F.length(digits).cast("string"), 2, "0"), digits))


def parse(cursor: Column) -> Column:
    """struct(key, offset, eof, ok); ok is false for text that is no cursor. Two-part cursors with
    an offset, of an older form, are read too; an empty cursor is the start."""
    parts = F.split(cursor, r"\|", -1)
    n = F.size(parts)
    last = F.get(parts, n - 1)
    number = F.when(last.rlike("^[0-9]+$"), last.try_cast("bigint"))
    at_end = (n == 2) & (last == END)
    ok = (cursor == "") | at_end | (n.isin(2, 3) & number.isNotNull())
    return F.struct(
        F.when(ok, F.get(parts, F.lit(0))).alias("key"),
        F.when(ok & ~at_end & (cursor != ""), number).alias("offset"),
        F.coalesce(at_end, F.lit(False)).alias("eof"),
        F.coalesce(ok, F.lit(False)).alias("ok"),
    )


def order(cursor: Column) -> Column:
    """What cursors sort by: key, then offset, its end last."""
    c = parse(cursor)
    return F.struct(c["key"].alias("key"), c["eof"].alias("eof"), F.coalesce(c["offset"], F.lit(-1)).alias("offset"))


def rendered(key: str, offset: int, at_end: bool) -> str:
    """``render`` of one cursor."""
    return f"{key}|{END}" if at_end else f"{key}|{len(str(offset)):02d}|{offset}"


def order_of(cursor: str) -> tuple[str, int | None, bool]:
    """(key, offset, at its end) of one cursor; fails on text that is none."""
    parts = cursor.split("|")
    if cursor == "":
        return "", None, False
    if len(parts) == 2 and parts[1] == END:
        return parts[0], None, True
    if len(parts) in (2, 3) and parts[-1].isascii() and parts[-1].isdigit():
        return parts[0], int(parts[-1]), False
    raise LogError(f"invalid cursor {cursor!r}")


def rank_of(cursor: str) -> tuple[str, bool, int]:
    """What one cursor sorts by, for stores that only go forward."""
    key, offset, at_end = order_of(cursor)
    return key, at_end, -1 if offset is None else offset
