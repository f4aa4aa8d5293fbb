"""Corpus-wide counts of numeric keys that documents yield, without a row for each key.

Documents are dealt by a hash into chunks of a fixed mean size. A chunk sorts and counts its keys
before anything is shuffled, so a key that a third of all documents hold leaves each chunk once, and
ships them as packed arrays to buckets by key range. A bucket adds up and answers every chunk with
one byte a key, 0 for a key met once in the corpus, else the logarithm of its count. The chunk, which
computes its keys again in the same order, reads the answers off by position. ``exchange`` is the same
round with questions and answers of any kind.

Texts that occur in several documents are read once: groups of equal texts are found by a 128-bit
hash with an aggregation that combines before its exchange, and a chunk skips all rows but the one
that stands for its group.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from logweir.llm.common import Scratch, wide_hash

#: Mean bytes of text in a chunk, copies included, and of text whose keys meet in one bucket.
CHUNK_BYTES, BUCKET_BYTES = 6_000_000, 4_000_000
_RIGHT = "__chunk int, kind int, id long, h1 long, h2 long, bucket int, blob binary"


class Docs:
    """The documents of one chunk, one for each distinct text, in a fixed order."""

    def __init__(self, left: pa.Table, right: pa.Table):
        kinds = right.column("kind").to_numpy()
        first = right.filter(pa.array(kinds == 0))
        wanted = set(zip(first.column("id").to_pylist(), first.column("h1").to_pylist(), first.column("h2").to_pylist(), strict=True))
        ids, h1, h2 = (left.column(c).to_pylist() for c in ("doc_id", "h1", "h2"))
        at = {}
        for i, key in enumerate(zip(ids, h1, h2, strict=True)):
            if key in wanted:
                at.setdefault(key, i)
        keys = sorted(at, key=lambda k: (k[1], k[2]))
        text = left.column("text")
        self.ids = [k[0] for k in keys]
        self.h1, self.h2 = [k[1] for k in keys], [k[2] for k in keys]
        self.texts = [(text[at[k]].as_py() or "").encode() for k in keys]
        self._codes = {}
        for kind in set(kinds.tolist()) - {0}:
            own = right.filter(pa.array(kinds == kind)).sort_by("bucket")
            self._codes[kind] = b"".join(own.column("blob").to_pylist())

    def codes(self, kind: int) -> np.ndarray:
        return np.frombuffer(self._codes.get(kind, b""), np.uint8)


class Chunks:
    """``docs`` needs doc_id and text. Groups of equal texts are in ``groups``: h1, h2, id (the
    smallest doc_id), copies."""

    def __init__(self, docs: DataFrame, scratch: Scratch):
        h1, h2 = wide_hash(F.coalesce(F.col("text"), F.lit("")))
        self.scratch = scratch
        self.hashed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), h1.alias("h1"), h2.alias("h2"), F.octet_length("text").alias("size"))
        self.groups = scratch.write(self.hashed.groupBy("h1", "h2").agg(F.min("doc_id").alias("id"), F.count(F.lit(1)).alias("copies"), F.max("size").alias("size")))
        # All rows are dealt, copies too, so that a chunk's memory is bounded whatever repeats.
        total = self.groups.agg(F.sum(F.col("size") * F.col("copies"))).first()[0] or 0
        self.count = max(1, -(-total // CHUNK_BYTES))
        self.bits = max(4, int(max(1, total // BUCKET_BYTES)).bit_length())
        chunk = lambda i: F.pmod(F.xxhash64(i, "h1"), F.lit(self.count)).cast("int")
        self.left = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", h1.alias("h1"), h2.alias("h2")).withColumn("__chunk", chunk(F.col("doc_id")))
        self.right = self.groups.select(chunk(F.col("id")).alias("__chunk"), F.lit(0).alias("kind"), "id", "h1", "h2", F.lit(0).alias("bucket"), F.lit(None).cast("binary").alias("blob"))

    def _cogrouped(self):
        return self.left.groupBy("__chunk").cogroup(self.right.groupBy("__chunk"))

    def each(self, fn: Callable[[Docs], pa.Table], schema: str) -> DataFrame:
        """Runs ``fn`` on every chunk."""

        def run(left, right):
            return fn(Docs(left, right))

        return self._cogrouped().applyInArrow(run, schema)

    def exchange(self, kind: int, ask: Callable[[Docs], Iterable[tuple[int, bytes]]], answer: Callable[[list[bytes]], list[bytes]]) -> None:
        """One round: every chunk asks buckets, a bucket answers each of its askers with bytes.

        ``ask`` gives (bucket, question) in rising order of buckets; afterwards ``Docs.codes(kind)``
        holds the answers in that order. Both functions are pure, so lost tasks can be run again."""

        def run(key, left, right):
            asked = list(ask(Docs(left, right)))
            return pa.table({"bucket": pa.array([b for b, _ in asked], pa.int32()), "chunk": pa.array([key[0].as_py()] * len(asked), pa.int32()), "blob": pa.array([q for _, q in asked], pa.binary())})

        def reply(rows):
            rows = rows.sort_by("chunk")
            out = answer(rows.column("blob").to_pylist())
            none = pa.nulls(len(out), pa.int64())
            return pa.table({"__chunk": rows.column("chunk"), "kind": pa.array([kind] * len(out), pa.int32()), "id": none, "h1": none, "h2": none, "bucket": rows.column("bucket"), "blob": pa.array(out, pa.binary())})

        sent = self._cogrouped().applyInArrow(run, "bucket int, chunk int, blob binary")
        self.right = self.right.unionByName(self.scratch.write(sent.groupBy("bucket").applyInArrow(reply, _RIGHT)))

    def count_keys(self, kind: int, keys: Callable[[Docs], np.ndarray]) -> None:
        """Adds the answers to a new kind of keys: ``Docs.codes(kind)`` has one for each distinct
        key, in rising order. Keys travel as 32 bits within their bucket, and two of them may,
        rarely, be taken for one."""
        bits = self.bits

        def ask(docs: Docs) -> Iterable[tuple[int, bytes]]:
            found, counts = np.unique(keys(docs), return_counts=True)
            packed = ((found << np.uint64(bits)) >> np.uint64(32)).astype(np.uint32)
            counts = np.minimum(counts, 255).astype(np.uint8)
            for b, lo, hi in by_bucket(found, bits):
                yield b, packed[lo:hi].tobytes() + counts[lo:hi].tobytes()

        def answer(blobs: list[bytes]) -> list[bytes]:
            sizes = [len(b) // 5 for b in blobs]
            every = np.frombuffer(b"".join(b[: 4 * n] for b, n in zip(blobs, sizes, strict=True)), np.uint32)
            weights = np.frombuffer(b"".join(b[4 * n :] for b, n in zip(blobs, sizes, strict=True)), np.uint8)
            found, at = np.unique(every, return_inverse=True)
            totals = np.bincount(at, weights, len(found))
            code = np.where(totals < 2, 0, np.minimum(255, 1 + np.floor(4 * np.log2(np.maximum(totals, 2) / 2)))).astype(np.uint8)[at]
            return cut(code, sizes)

        self.exchange(kind, ask, answer)


def by_bucket(keys: np.ndarray, bits: int) -> Iterator[tuple[int, int, int]]:
    """(bucket, from, to) of each bucket that sorted 64-bit keys fall into, by their leading bits."""
    bucket = (keys >> np.uint64(64 - bits)).astype(np.int64)
    starts = np.flatnonzero(np.diff(bucket, prepend=-1))
    yield from zip(bucket[starts].tolist(), starts.tolist(), np.append(starts, len(keys))[1:].tolist(), strict=True)


def cut(answers: np.ndarray, sizes: list[int]) -> list[bytes]:
    ends = np.cumsum([0, *sizes])
    return [answers[ends[i] : ends[i + 1]].tobytes() for i in range(len(sizes))]
