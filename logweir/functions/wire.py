"""Wire form of events and requests: protocol buffer fields, coded here without generated classes.

Column functions would need a descriptor jar; these work on driver-side values and in Arrow batches.
"""

from __future__ import annotations

from dataclasses import dataclass
from datetime import datetime, timedelta, timezone

from logweir.options import StreamOptions

_EPOCH = datetime(1970, 1, 1, tzinfo=timezone.utc)


def _varint(n: int) -> bytes:
    n &= (1 << 64) - 1
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _field(number: int, value: int | bytes) -> bytes:
    """Defaults are left out."""
    if not value:
        return b""
    if isinstance(value, int):
        return _varint(number << 3) + _varint(value)
    return _varint(number << 3 | 2) + _varint(len(value)) + value


def _fields(raw: bytes) -> dict[int, int | bytes]:
    out: dict[int, int | bytes] = {}
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            b = raw[at]
            at += 1
            value |= (b & 127) << shift
            if b < 128:
                return value
            shift += 7

    while at < len(raw):
        key = varint()
        if key & 7 == 0:
            out[key >> 3] = varint()
        elif key & 7 == 2:
            n = varint()
            out[key >> 3] = raw[at : at + n]
            at += n
        else:
            raise ValueError(f"wire type {key & 7}")
    return out


def _signed(n: int) -> int:
    return n - (1 << 64) if n >> 63 else n


def _seconds_nanos(micros: int) -> bytes:
    seconds, rest = divmod(micros, 1_000_000)
    return _field(1, seconds) + _field(2, rest * 1000)


def _micros(raw: bytes) -> int:
    f = _fields(raw)
    return _signed(f.get(1, 0)) * 1_000_000 + _signed(f.get(2, 0)) // 1000


@dataclass(frozen=True)
class WireEvent:
    id: str
    type: int
    foreign_id: str
    timestamp: datetime
    metadata: bytes = b""
    trace: bytes = b""


# Fixed field numbers. Event: type 3, timestamp 4, foreign_id 5, id 6, metadata 7, trace 8.
# Options: lag 1, from head 2, to head 4. Request: options 2, after 3.
def event_to_wire(e: WireEvent) -> bytes:
    micros = (e.timestamp - _EPOCH) // timedelta(microseconds=1)
    return _field(3, e.type) + _field(4, _seconds_nanos(micros)) + _field(5, e.foreign_id.encode()) + _field(6, e.id.encode()) + _field(7, e.metadata) + _field(8, e.trace)


def event_from_wire(raw: bytes) -> WireEvent:
    f = _fields(raw)
    kind = _signed(f.get(3, 0))
    return WireEvent(f.get(6, b"").decode(), kind, f.get(5, b"").decode(), _EPOCH + timedelta(microseconds=_micros(f.get(4, b""))), f.get(7, b""), f.get(8, b""))


def options_to_wire(o: StreamOptions) -> bytes:
    lag = _field(1, _seconds_nanos(o.lag // timedelta(microseconds=1))) if o.lag > timedelta(0) else b""
    return lag + _field(2, int(o.from_head)) + _field(4, int(o.to_head))


def options_from_wire(raw: bytes) -> StreamOptions:
    f = _fields(raw)
    return StreamOptions(timedelta(microseconds=_micros(f.get(1, b""))), bool(f.get(2, 0)), bool(f.get(4, 0)))


def request_to_wire(after: str, options: StreamOptions) -> bytes:
    return _field(2, options_to_wire(options)) + _field(3, after.encode())


def request_from_wire(raw: bytes) -> tuple[str, StreamOptions]:
    f = _fields(raw)
    return f.get(3, b"").decode(), options_from_wire(f.get(2, b""))
