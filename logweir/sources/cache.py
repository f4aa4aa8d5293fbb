"""A cache of a log's newest events on the executors, so that consumers near the head share one load."""

from __future__ import annotations

import threading
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Ids that are kept.
SIZE = 10_000


@dataclass
class Piece:
    """Ids behind ``after`` up to ``upto``, persisted."""

    after: int
    upto: int
    rows: DataFrame


class TailCache:
    """Ranges of a log from persisted pieces where they hold them, else from the log.

    ``events`` gives the events behind an id, from the files that hold them (``StoredLog.events``). The pieces
    are one range without a break. A range that goes on where they end is loaded from there and appended; one
    that begins behind their end takes their place; an older one is read and not kept. Pieces leave from the
    front once more than ``size`` ids are kept. They lie in the executors' memory and disk, and a piece
    that is lost with an executor is read again from its files.

    What is kept must not change, so ranges should end before the first hole, as those of the live
    source do. ``Spec.cache`` has consumers of one log share one cache."""

    def __init__(self, events: Callable[[int], DataFrame], *, size: int = SIZE, enabled: bool = True, metrics=None, label: str = ""):
        self.events, self.size, self.enabled, self.metrics, self.label = events, size, enabled, metrics, label
        self.pieces: list[Piece] = []
        self.hits, self.misses = 0, 0
        self._lock = threading.Lock()

    def _count(self, hit: bool) -> None:
        self.hits, self.misses = self.hits + hit, self.misses + (not hit)
        if self.metrics:
            self.metrics.add("cache_hits" if hit else "cache_misses", self.label)

    def between(self, after: int, upto: int) -> DataFrame:
        """The events behind ``after`` up to ``upto``."""
        if not self.enabled:
            return self._load(after, upto)
        with self._lock:
            held = self.pieces and self.pieces[0].after <= after <= self.pieces[-1].upto
            self._count(bool(held and upto <= self.pieces[-1].upto))
            if held and upto > self.pieces[-1].upto:
                self._keep(self.pieces[-1].upto, upto)
            elif not held and (not self.pieces or after > self.pieces[-1].upto):
                self._drop(len(self.pieces))
                self._keep(after, upto)
            elif not held:
                return self._load(after, upto)
            rows = [p.rows for p in self.pieces if p.after < upto and p.upto > after]
            self._trim()
        out = rows[0] if rows else self.events(after).limit(0)
        for more in rows[1:]:
            out = out.unionByName(more)
        return out.where(F.col("id").between(after + 1, upto))

    def _load(self, after: int, upto: int) -> DataFrame:
        return self.events(after).where(F.col("id") <= upto)

    def _keep(self, after: int, upto: int) -> None:
        rows = self._load(after, upto).persist(StorageLevel.MEMORY_AND_DISK)
        # One load, whoever comes first.
        rows.count()
        self.pieces.append(Piece(after, upto, rows))

    def _trim(self) -> None:
        k = 0
        while k + 1 < len(self.pieces) and self.pieces[-1].upto - self.pieces[k + 1].after >= self.size:
            k += 1
        self._drop(k)

    def _drop(self, n: int) -> None:
        for piece in self.pieces[:n]:
            piece.rows.unpersist()
        del self.pieces[:n]

    def close(self) -> None:
        with self._lock:
            self._drop(len(self.pieces))
