"""Trace bytes: a message of two hexadecimal strings, trace id (32) and span id (16)."""

from __future__ import annotations

import re
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark.sql import Column
from pyspark.sql import functions as F


def valid(trace_id: Column, span_id: Column) -> Column:
    good = trace_id.rlike("^[0-9a-f]{32}$") & ~trace_id.rlike("^0+$") & span_id.rlike("^[0-9a-f]{16}$") & ~span_id.rlike("^0+$")
    return F.coalesce(good, F.lit(False))


def marshal(trace_id: Column, span_id: Column) -> Column:
    """Null where the context is not valid."""
    raw = F.concat(F.unhex(F.lit("0A20")), F.encode(trace_id, "UTF-8"), F.unhex(F.lit("1210")), F.encode(span_id, "UTF-8"))
    return F.when(valid(trace_id, span_id), raw)


def unmarshal(raw: Column) -> Column:
    """struct(trace_id, span_id); null for bytes that are no valid trace."""
    digits = F.hex(raw)
    text = lambda start, n: F.decode(F.unhex(F.substring(digits, start, n)), "ISO-8859-1")
    trace_id, span_id = text(5, 64), text(73, 32)
    shape = (F.length(digits) == 104) & (F.substring(digits, 1, 4) == "0A20") & (F.substring(digits, 69, 4) == "1210")
    return F.when(shape & valid(trace_id, span_id), F.struct(trace_id.alias("trace_id"), span_id.alias("span_id")))


_CURRENT: ContextVar[tuple[str, str] | None] = ContextVar("trace", default=None)


@contextmanager
def in_trace(trace_id: str, span_id: str):
    """Events that are appended inside carry this trace."""
    token = _CURRENT.set((trace_id, span_id))
    try:
        yield
    finally:
        _CURRENT.reset(token)


def current_trace() -> bytes | None:
    """The bytes of the trace that is current here; none if there is none or it is not valid."""
    now = _CURRENT.get()
    if now is None or not all(re.fullmatch(f"[0-9a-f]{{{n}}}", x) and x.strip("0") for x, n in zip(now, (32, 16), strict=True)):
        return None
    return b"\x0a\x20" + now[0].encode() + b"\x12\x10" + now[1].encode()
