"""Repeated substrings over the whole corpus, by prefix-free parsing and suffix order.

A window is 200 bytes. Rolling hashes of 16-byte strings are taken at every position; the trigger of
a window is the least one among its first 85 positions, leftmost where equal, so equal windows have
equal triggers at equal offsets. The windows with one trigger form a phrase: consecutive starts
s0..s1, determined by the text [s0, s1 + 200). Its anchor is the 116 bytes from the trigger on, which
all its windows contain. Every window lies in one phrase, and equal windows have equal anchors, so
the suffix order of the corpus falls apart by anchor: no task needs more of it than its anchors.

1. Parse. Chunks of documents ship each distinct phrase once, as hashes of anchor and text with a
   count, to buckets of anchors. An anchor met once holds no repeated window, which settles all text
   that is not copied. An anchor whose phrases all have one text repeats whole: its place in the
   order is known without sorting. Only anchors with different texts, at the edges of repeats, are left.
2. Order. Of these, one chunk ships the text of each phrase to its bucket, where suffix arrays of the
   dictionary and of the parse (``suffix_order``) combine into the order of all its suffixes;
   neighbours that agree in 200 bytes, compared as bytes, repeat. Anchors that more than ``HOT``
   different texts share, such as a passage that a third of all documents hold and go on from in
   their own ways, would make one bucket grow with the corpus; their windows meet by 128-bit hashes
   instead, which spreads them over all buckets.
3. Runs. Chunks join the repeated windows of each text into runs and hash what is left.

A passage that a third of all documents holds leaves each chunk once. Documents with equal texts are
parsed once. Where a decision rests on hashes, it is that all phrases of an anchor, or two phrases
among at most ``HOT``, have one 64-bit hash next to one 64-bit anchor, or on 128 bits.

Edge cases. A null or empty text has no window; texts below 200 bytes lose nothing. Matches never
cross documents. Texts that occur twice, also in repeated rows, are removed whole if 200 bytes or
more. Null doc_ids are documents like others. Extra columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.chunks import Chunks, Docs, by_bucket, cut
from logweir.llm.common import Scratch, table
from logweir.llm.suffix_order import suffix_order
from logweir.llm.text_hash import BATCH, mix, prefix_hash, span_hash

LENGTH, GRAM, REACH = 200, 16, 85
#: Different texts of one anchor that a bucket sorts, and bytes that it sorts at once.
HOT, SORTED_BYTES = 4096, 2_000_000
#: Verdicts on a phrase: met once; all of its anchor repeat; to be sorted, alone or known to repeat,
#: shipped by this chunk or by another; windows to be looked at one by one.
ONCE, ALL, SINGLE, SHIPPED, KNOWN, WINDOWS = range(6)
_POSITION = np.uint64((1 << 20) - 1)
_SALT = np.uint64(0xA24BAED4963EE407)


class Phrases(NamedTuple):
    """Phrases of some texts: the text's index, the first and last start in it, and hashes."""

    text: np.ndarray
    first: np.ndarray
    last: np.ndarray
    right: np.ndarray
    whole: np.ndarray
    #: Piece of text and offset of the phrase in it, to look at its windows later.
    raw: np.ndarray
    at: np.ndarray


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """(text, offset in it, bytes) gathered to about BATCH bytes; long texts overlap by a window."""
    now, size = [], 0
    for i, text in enumerate(texts):
        for at in range(0, max(0, len(text) - length + 1), BATCH):
            part = text[at : at + BATCH + length - 1]
            if now and size + len(part) > BATCH:
                yield now
                now, size = [], 0
            now.append((i, at, part))
            size += len(part)
    if now:
        yield now


def phrases(texts: list[bytes], length: int = LENGTH, reach: int = REACH, gram: int = GRAM) -> Iterator[Phrases]:
    for pieces in _pieces(texts, length):
        raw = np.frombuffer(b"".join(p for _, _, p in pieces), np.uint8)
        prefix = prefix_hash(raw)
        where = np.arange(len(raw) - gram + 1)
        least = (span_hash(prefix, where, where + gram) & ~_POSITION) | where.astype(np.uint64)
        width = 1
        while 2 * width <= reach:
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        if width < reach:
            least = np.minimum(least[: -(reach - width)], least[reach - width :])
        begin = np.cumsum([0, *(len(p) for _, _, p in pieces)])
        starts = np.concatenate([np.arange(b, e - length + 1) for b, e in zip(begin[:-1], begin[1:], strict=True)])
        trigger = (least[starts] & _POSITION).astype(np.int64)
        cut = np.flatnonzero(np.diff(trigger)) + 1
        lo, hi = np.concatenate([[0], cut]), np.concatenate([cut, [len(starts)]]) - 1
        first, last, trigger = starts[lo], starts[hi], trigger[lo]
        piece = np.searchsorted(begin, first, "right") - 1
        right = span_hash(prefix, trigger, trigger + length - reach + 1)
        whole = mix(span_hash(prefix, first, last + length) + (trigger - first).astype(np.uint64) * _SALT)
        offset = np.array([at for _, at, _ in pieces])[piece] - begin[piece]
        yield Phrases(np.array([i for i, _, _ in pieces])[piece], first + offset, last + offset, right, whole, raw, first)


class Parse:
    """The phrases of a chunk, and what the rounds say about them."""

    def __init__(self, docs: Docs, length: int):
        self.docs, self.length, self.batches = docs, length, list(phrases(docs.texts, length))
        join = lambda k, t: np.concatenate([getattr(b, k) for b in self.batches]) if self.batches else np.zeros(0, t)
        self.text, self.first, self.last = (join(k, np.int64) for k in ("text", "first", "last"))
        self.right, self.whole = join("right", np.uint64), join("whole", np.uint64)

    def distinct(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """An index for each distinct phrase, by anchor and then by text; for each phrase its number; counts."""
        _, some, number, counts = np.unique(self.whole, return_index=True, return_inverse=True, return_counts=True)
        order = np.lexsort((self.whole[some], self.right[some]))
        back = np.empty(len(order), np.int64)
        back[order] = np.arange(len(order))
        return some[order], back[number], counts[order]

    def ask_parse(self, bits: int) -> Iterator[tuple[int, bytes]]:
        some, _, counts = self.distinct()
        right, whole, counts = self.right[some], self.whole[some], np.minimum(counts, 255).astype(np.uint8)
        for b, lo, hi in by_bucket(right, bits):
            yield b, right[lo:hi].tobytes() + whole[lo:hi].tobytes() + counts[lo:hi].tobytes()

    def texts_of(self, chosen: np.ndarray) -> list[bytes]:
        return [self.docs.texts[t][a : b + self.length] for t, a, b in zip(self.text[chosen].tolist(), self.first[chosen].tolist(), self.last[chosen].tolist(), strict=True)]

    def windows(self, chosen: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text, start and two hashes of each window of the chosen phrases, batch by batch."""
        out, at = [], 0
        for b in self.batches:
            own = chosen[at : at + len(b.first)]
            at += len(b.first)
            if not own.any():
                continue
            n = (b.last - b.first + 1)[own]
            step = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            place = np.repeat(b.at[own], n) + step
            hashes = [span_hash(prefix_hash(b.raw, second), place, place + self.length) for second in (False, True)]
            out.append((np.repeat(b.text[own], n), np.repeat(b.first[own], n) + step, *hashes))
        if not out:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        return tuple(np.concatenate(x) for x in zip(*out, strict=True))

    def hot_windows(self, verdict: np.ndarray) -> tuple[np.ndarray, ...]:
        """Text and start of windows to be looked at one by one, for each the number of its distinct
        window, and of those two hashes and counts, in rising order."""
        text, start, one, two = self.windows(verdict == WINDOWS)
        order = np.lexsort((two, one))
        new = np.diff(one[order], prepend=0) != 0
        new |= np.diff(two[order], prepend=0) != 0
        new[:1] = True
        number = np.empty(len(order), np.int64)
        number[order] = np.cumsum(new) - 1
        return text, start, number, one[order][new], two[order][new], np.bincount(number, minlength=int(new.sum()))

    def verdicts(self) -> tuple[np.ndarray, np.ndarray]:
        """The verdict on each phrase, and an index for each whose text this chunk ships."""
        some, number, _ = self.distinct()
        codes = self.docs.codes(1)
        return codes[number], some[(codes == SINGLE) | (codes == SHIPPED)]

    def ask_order(self, bits: int) -> Iterator[tuple[int, bytes]]:
        """Texts go to buckets of anchors; single windows to as many more, by their hashes."""
        verdict, shipped = self.verdicts()
        for b, lo, hi in by_bucket(self.right[shipped], bits):
            texts = self.texts_of(shipped[lo:hi])
            sizes = np.array([len(t) for t in texts], np.uint16)
            yield b, np.uint64(len(texts)).tobytes() + self.right[shipped[lo:hi]].tobytes() + sizes.tobytes() + b"".join(texts)
        _, _, _, one, two, counts = self.hot_windows(verdict)
        counts = np.minimum(counts, 255).astype(np.uint8)
        for b, lo, hi in by_bucket(one, bits):
            yield (1 << bits) + b, np.uint64(0).tobytes() + one[lo:hi].tobytes() + two[lo:hi].tobytes() + counts[lo:hi].tobytes()

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Text, first and last start of runs of repeated windows, in order and apart."""
        verdict, shipped = self.verdicts()
        answers = self.docs.codes(2)
        wide = _wide(self.length)
        bits = np.unpackbits(answers[: wide * len(shipped)].reshape(-1, wide), axis=1)
        single = self.docs.codes(1)[self.distinct()[1]][shipped] == SINGLE
        step = np.diff(np.pad(bits[single].astype(np.int8), ((0, 0), (1, 1))), axis=1)
        (row, lo), (_, hi) = np.nonzero(step == 1), np.nonzero(step == -1)
        some = shipped[single][row]
        text, start, number, *_ = self.hot_windows(verdict)
        again = answers[wide * len(shipped) :][number] > 0 if len(number) else np.zeros(0, bool)
        whole = (verdict == ALL) | (verdict == SHIPPED) | (verdict == KNOWN)
        text = np.concatenate([self.text[whole], self.text[some], text[again]])
        first = np.concatenate([self.first[whole], self.first[some] + lo, start[again]])
        last = np.concatenate([self.last[whole], self.first[some] + hi - 1, start[again]])
        order = np.lexsort((first, text))
        return text[order], first[order], last[order]


def _wide(length: int) -> int:
    """Bytes of a bit for each window of a phrase."""
    return -(-min(REACH, length) // 8)


def answer_parse(blobs: list[bytes]) -> list[bytes]:
    sizes = [len(b) // 17 for b in blobs]
    part = lambda lo, hi, kind: np.frombuffer(b"".join(b[lo * n : hi * n] for b, n in zip(blobs, sizes, strict=True)), kind)
    right, whole, counts = part(0, 8, np.uint64), part(8, 16, np.uint64), part(16, 17, np.uint8)
    order = np.lexsort((whole, right))
    r, w = right[order], whole[order]
    new_anchor = np.diff(r, prepend=0) != 0
    new_anchor[:1] = True
    new_text = new_anchor | (np.diff(w, prepend=0) != 0)
    anchor, text = np.cumsum(new_anchor) - 1, np.cumsum(new_text) - 1
    texts = np.bincount(anchor[new_text])[anchor] if len(r) else anchor
    total = np.bincount(text, counts[order])[text] if len(r) else text
    code = np.where(total > 1, np.where(new_text, SHIPPED, KNOWN), SINGLE)
    code = np.where(texts > HOT, WINDOWS, code)
    code = np.where(texts == 1, np.where(total > 1, ALL, ONCE), code)
    out = np.empty(len(r), np.uint8)
    out[order] = code
    return cut(out, sizes)


def answer_order(length: int):
    def run(blobs: list[bytes]) -> list[bytes]:
        if not any(np.frombuffer(b[:8], np.uint64)[0] for b in blobs):
            return _window_counts([b[8:] for b in blobs])
        anchors, texts, counts = [], [], []
        for b in blobs:
            n = int(np.frombuffer(b[:8], np.uint64)[0])
            counts.append(n)
            anchors.append(np.frombuffer(b[8 : 8 + 8 * n], np.uint64))
            ends = (np.cumsum(np.frombuffer(b[8 + 8 * n : 8 + 10 * n], np.uint16).astype(np.int64)) + 8 + 10 * n).tolist()
            texts += [b[lo:hi] for lo, hi in zip([8 + 10 * n, *ends[:-1]], ends, strict=True)]
        anchor = np.concatenate(anchors)
        bits = np.zeros((len(texts), 8 * _wide(length)), bool)
        by_anchor = np.argsort(anchor, kind="stable")
        volume = np.cumsum(np.array([len(t) for t in texts])[by_anchor]) // SORTED_BYTES
        # Parts end where an anchor ends.
        part = volume[np.searchsorted(anchor[by_anchor], anchor[by_anchor])]
        for rows in np.split(by_anchor, np.flatnonzero(np.diff(part)) + 1):
            text, start, same = suffix_order([texts[i] for i in rows.tolist()], length)
            again = same | np.append(same[1:], False)
            bits[rows[text[again]], start[again]] = True
        return cut(np.packbits(bits, axis=1), counts)

    return run


def _window_counts(blobs: list[bytes]) -> list[bytes]:
    sizes = [len(b) // 17 for b in blobs]
    part = lambda lo, hi, kind: np.frombuffer(b"".join(b[lo * n : hi * n] for b, n in zip(blobs, sizes, strict=True)), kind)
    one, two, counts = part(0, 8, np.uint64), part(8, 16, np.uint64), part(16, 17, np.uint8)
    order = np.lexsort((two, one))
    new = (np.diff(one[order], prepend=0) != 0) | (np.diff(two[order], prepend=0) != 0)
    new[:1] = True
    number = np.empty(len(order), np.int64)
    number[order] = np.cumsum(new) - 1
    return cut((np.bincount(number, counts)[number] > 1).astype(np.uint8), sizes)


_DIGEST = "h1 long, h2 long, n_bytes long, n_removed long, n_spans long, kept_sha256 string, span_starts array<long>, span_ends array<long>"


def _digest(docs: Docs, length: int) -> pa.Table:
    text, first, last = Parse(docs, length).repeated()
    bounds = np.searchsorted(text, np.arange(len(docs.texts) + 1))
    size, removed, spans, sha, starts, ends = [], [], [], [], [], []
    for i, raw in enumerate(docs.texts):
        lo, hi = first[bounds[i] : bounds[i + 1]], last[bounds[i] : bounds[i + 1]] + length
        # Windows that overlap or touch make one run.
        apart = lo[1:] > hi[:-1]
        lo, hi = lo[np.append(True, apart)[: len(lo)]], hi[np.append(apart, True)[: len(hi)]]
        kept, at = hashlib.sha256(), 0
        for a, b in zip(lo.tolist(), hi.tolist(), strict=True):
            kept.update(raw[at:a])
            at = b
        kept.update(raw[at:])
        size.append(len(raw))
        removed.append(int((hi - lo).sum()))
        spans.append(len(lo))
        sha.append(kept.hexdigest())
        starts.append(lo)
        ends.append(hi)
    lists = pa.list_(pa.int64())
    return pa.table({"h1": pa.array(docs.h1, pa.int64()), "h2": pa.array(docs.h2, pa.int64()), "n_bytes": pa.array(size, pa.int64()), "n_removed": pa.array(removed, pa.int64()), "n_spans": pa.array(spans, pa.int64()), "kept_sha256": pa.array(sha, pa.string()), "span_starts": pa.array(starts, lists), "span_ends": pa.array(ends, lists)})


def repeated_spans(docs: DataFrame, *, length: int = LENGTH) -> DataFrame:
    """For each row its repeated runs of bytes (span_starts, span_ends) and the digest of what is left."""
    scratch = Scratch(docs.sparkSession, "repeats")
    chunks = Chunks(docs, scratch)
    bits = chunks.bits
    chunks.exchange(1, lambda d: Parse(d, length).ask_parse(bits), answer_parse)
    chunks.exchange(2, lambda d: Parse(d, length).ask_order(bits), answer_order(length))
    once = chunks.each(lambda d: _digest(d, length), _DIGEST)
    whole = (F.col("copies") > 1) & (F.col("n_bytes") >= length)
    one = lambda x: F.array(x).cast("array<bigint>")
    group = once.join(chunks.groups.select("h1", "h2", "copies"), ["h1", "h2"]).select(
        "h1", "h2", "n_bytes",
        F.when(whole, F.col("n_bytes")).otherwise(F.col("n_removed")).alias("n_removed"),
        F.when(whole, 1).otherwise(F.col("n_spans")).cast("long").alias("n_spans"),
        F.when(whole, hashlib.sha256().hexdigest()).otherwise(F.col("kept_sha256")).alias("kept_sha256"),
        F.when(whole, one(F.lit(0))).otherwise(F.col("span_starts")).alias("span_starts"),
        F.when(whole, one(F.col("n_bytes"))).otherwise(F.col("span_ends")).alias("span_ends"),
    )
    # Written out, so that the join may split a text that very many rows share.
    group = scratch.write(group)
    return chunks.hashed.select("doc_id", "h1", "h2").join(group, ["h1", "h2"]).drop("h1", "h2")


def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = repeated_spans(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")
