"""Options of a stream."""

from __future__ import annotations

from dataclasses import dataclass
from datetime import timedelta


@dataclass(frozen=True)
class StreamOptions:
    """lag: only events at least so old; from_head: start after the present head; to_head: end there."""

    lag: timedelta = timedelta(0)
    from_head: bool = False
    to_head: bool = False

    def as_source_options(self) -> dict[str, str]:
        """For ``readStream.options``; what is off is left out."""
        out = {}
        if self.lag > timedelta(0):
            out["lagMicros"] = str(self.lag // timedelta(microseconds=1))
        if self.from_head:
            out["fromHead"] = "true"
        if self.to_head:
            out["toHead"] = "true"
        return out

    @classmethod
    def from_source_options(cls, options) -> "StreamOptions":
        flag = lambda k: str(options.get(k, "false")).lower() == "true"
        return cls(timedelta(microseconds=int(options.get("lagMicros", 0))), flag("fromHead"), flag("toHead"))
