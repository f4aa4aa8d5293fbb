"""Counters, gauges and histograms of live consumers, logs and blob streams.

One registry may serve many runs. What a consumer was given is one aggregation over each micro-batch;
what the engine did is told by a listener of its progress. Nothing is kept by event.

Of a query: ``polls`` are its looks at the log, ``load_seconds`` the time that a look and the planning of what
it found took, ``decoded_rows`` the events that were read, and ``decode_seconds`` the time of the job
that read them, without the consumer's. Listener and filler of gaps, the tail cache, and batch and dead-letter
consumers tell theirs where they are given the registry (``Spec.metrics``).
"""

from __future__ import annotations

import threading
import time
from collections import defaultdict
from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQueryListener

from logweir.functions.ages import age_seconds
from logweir.operators.health import AGE_BUCKETS, DECODE_BUCKETS, LATENCY_BUCKETS, LOAD_BUCKETS

#: By name: kind, and for histograms the bounds.
KINDS: dict[str, tuple] = {
    "consumer_lag_seconds": ("gauge",), "consumer_lag_alert": ("gauge",), "consumer_active": ("gauge",),
    "consumer_age_seconds": ("histogram", AGE_BUCKETS), "consumer_latency_seconds": ("histogram", LATENCY_BUCKETS),
    "consumer_errors": ("counter",), "consumer_dead_letters": ("counter",), "consumer_skipped": ("counter",),
    "cursor_sets": ("counter",), "polls": ("counter",), "blocking_gaps": ("gauge",), "gaps_detected": ("counter",), "gaps_filled": ("counter",), "gap_listeners": ("gauge",),
    "cache_hits": ("counter",), "cache_misses": ("counter",), "decoded_rows": ("counter",), "decode_seconds": ("histogram", DECODE_BUCKETS), "load_seconds": ("histogram", LOAD_BUCKETS),
    "blobs_listed": ("counter",), "blob_errors": ("counter",), "batch_buffered": ("gauge",),
}


class Progress(StreamingQueryListener):
    """What the engine tells of the queries of one name."""

    def __init__(self, metrics: "Metrics", name: str):
        self.metrics, self.name = metrics, name
        self.queries: set[str] = set()
        self.ended = threading.Event()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        if event.name == self.name:
            self.queries.add(str(event.id))

    def onQueryProgress(self, event) -> None:  # noqa: N802
        progress = event.progress
        if progress.name != self.name:
            return
        spent = {k: v / 1000 for k, v in progress.durationMs.items()}
        self.metrics.add("polls", self.name)
        self.metrics.observe("load_seconds", self.name, sum(spent.get(k, 0.0) for k in ("latestOffset", "getBatch", "queryPlanning")))
        if progress.numInputRows:
            self.metrics.add("decoded_rows", self.name, progress.numInputRows)
            own = self.metrics.taken(self.name)
            self.metrics.observe("decode_seconds", self.name, max(0.0, spent.get("addBatch", 0.0) - own))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        if str(event.id) in self.queries:
            self.metrics.add("polls", self.name)

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        if str(event.id) in self.queries:
            self.ended.set()


class Metrics:
    def __init__(self, clock=time.time):
        self.clock, self._lock = clock, threading.Lock()
        self._values: dict[tuple[str, str], float] = {}
        self._buckets: dict[tuple[str, str], list[float]] = {}
        #: Last time of activity and time to live of consumers that report it.
        self._seen: dict[str, tuple[float, float]] = {}
        self._before: dict[int, dict[str, int]] = defaultdict(dict)
        #: Seconds of consumers since the engine's last progress.
        self._taken: dict[str, float] = defaultdict(float)

    def add(self, name: str, label: str = "", n: float = 1) -> None:
        with self._lock:
            self._values[name, label] = self._values.get((name, label), 0) + n

    def gauge(self, name: str, label: str, value: float | None) -> None:
        """Sets a gauge; nothing takes it away."""
        with self._lock:
            if value is None:
                self._values.pop((name, label), None)
            else:
                self._values[name, label] = value

    def observe(self, name: str, label: str, value: float) -> None:
        self.observe_counts(name, label, [value <= b for b in KINDS[name][1]], 1, value)

    def observe_counts(self, name: str, label: str, at_most: Iterable[int], n: int, total: float) -> None:
        """Adds counts of values up to each bound, the number of all and their sum."""
        with self._lock:
            now = self._buckets.setdefault((name, label), [0.0] * (len(KINDS[name][1]) + 2))
            for k, more in enumerate([*at_most, n, total]):
                now[k] += more

    def listener(self, consumer) -> Progress:
        return Progress(self, consumer.name)

    def taken(self, name: str) -> float:
        with self._lock:
            return self._taken.pop(name, 0.0)

    def started(self, consumer) -> None:
        self.gauge("consumer_lag_seconds", consumer.name, 0.0)
        if consumer.activity_ttl is not None:
            self._seen[consumer.name] = (self.clock(), consumer.activity_ttl)

    def stopped(self, consumer) -> None:
        self.gauge("consumer_lag_seconds", consumer.name, None)

    def consumed(self, consumer, rows: DataFrame, seconds: float) -> None:
        """Takes in a micro-batch that a consumer was given."""
        from logweir.operators.filters import consumer_outcome

        name = consumer.name
        age = age_seconds(F.col("timestamp"), F.current_timestamp())
        skipped = consumer_outcome(consumer.types, consumer.event_filter) == "skipped"
        sums = rows.select(age.alias("age"), skipped.alias("skipped")).agg(F.count(F.lit(1)), F.sum("age"), F.min("age"), F.count_if("skipped"), *[F.count_if(F.col("age") <= b) for b in AGE_BUCKETS]).first()
        n, total, least, skips, *at_most = sums
        if n:
            self.observe_counts("consumer_age_seconds", name, at_most, n, total)
            self.gauge("consumer_lag_seconds", name, least)
            if consumer.lag_alert is not None:
                self.gauge("consumer_lag_alert", name, float(least > consumer.lag_alert))
        self.observe("consumer_latency_seconds", name, seconds)
        with self._lock:
            self._taken[name] += seconds
        if skips:
            self.add("consumer_skipped", name, skips)
        self.counted(consumer)
        if consumer.activity_ttl is not None:
            self._seen[name] = (self.clock(), consumer.activity_ttl)

    def counted(self, consumer) -> None:
        """Takes over what a consumer has counted since."""
        name = consumer.name
        for key, metric in (("errors", "consumer_errors"), ("dead_letters", "consumer_dead_letters")):
            before = self._before[id(consumer.counts)]
            more = consumer.counts.get(key, 0) - before.get(key, 0)
            if more:
                self.add(metric, name, more)
                before[key] = consumer.counts[key]

    def value(self, name: str, label: str = "") -> float | None:
        if name == "consumer_active":
            seen = self._seen.get(label)
            return None if seen is None else float(self.clock() - seen[0] < seen[1])
        return self._values.get((name, label))

    def samples(self) -> list[tuple[str, str, str, float]]:
        """(name, label, bound, value), a histogram as a row for each bound, count and sum."""
        with self._lock:
            out = [(name, label, "", v) for (name, label), v in self._values.items()]
            for (name, label), counts in self._buckets.items():
                bounds = [*map(str, KINDS[name][1]), "count", "sum"]
                out += [(name, label, b, v) for b, v in zip(bounds, counts, strict=True)]
        out += [("consumer_active", name, "", self.value("consumer_active", name)) for name in self._seen]
        return sorted(out)

    def text(self) -> str:
        """The samples a line each."""
        return "".join(f'{n}{{label="{label}"{", le=" + chr(34) + b + chr(34) if b else ""}}} {v:g}\n' for n, label, b, v in self.samples())
