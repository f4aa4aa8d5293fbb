"""Media columns: Matroska files in a binary column, written and parsed into packet tables.

Writer. A payload becomes one 8-bit PCM track: frames of 576 samples, up to eight in a laced
SimpleBlock, 32 blocks in a Cluster with a timestamp, and a CuePoint for each Cluster.

Parser. EBML ids and sizes are read as variable-length integers; an element of unknown size, as live
recordings have, ends where one comes that cannot be inside it, or with its parent. It walks Segment, Info, Tracks, Clusters, SimpleBlocks and BlockGroups, and Cues, splits
fixed, Xiph and EBML lacing, and gives one packet a frame: track, timestamp in nanoseconds, byte
offset and length, keyframe flag, cluster number. It copies no frame: packets are byte ranges.

Both run in Arrow batches where the rows lie, without a shuffle.

Edge cases. A null or empty text pads to 576 bytes of 255. Unknown elements are skipped. A truncated
or foreign file gives the packets before the damage and a non-empty ``error``. A null file gives no
packets. Repeated rows are handled separately; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import table

FRAME, LACE, BLOCKS, RATE = 576, 8, 32, 8000
# Fixed values of the format: element ids.
EBML, SEGMENT, INFO, TRACKS, ENTRY, AUDIO, CLUSTER, CUES = 0x1A45DFA3, 0x18538067, 0x1549A966, 0x1654AE6B, 0xAE, 0xE1, 0x1F43B675, 0x1C53BB6B
SCALE, DURATION, TIMESTAMP, SIMPLE, GROUP, BLOCK, REFERENCE = 0x2AD7B1, 0x4489, 0xE7, 0xA3, 0xA0, 0xA1, 0xFB
NUMBER, UID, KIND, LACING, CODEC, SAMPLING, CHANNELS, DEPTH = 0xD7, 0x73C5, 0x83, 0x9C, 0x86, 0xB5, 0x9F, 0x6264
POINT, CUE_TIME, POSITIONS, CUE_TRACK, CUE_CLUSTER = 0xBB, 0xB3, 0xB7, 0xF7, 0xF1
# SeekHead, Chapters, Attachments and Tags, which are skipped.
_OTHERS = {0x114D9B74, 0x1043A770, 0x1941A469, 0x1254C367}
#: Elements that only make sense inside one of others, and those that end one of unknown size.
_PLACES = {BLOCK: {GROUP}, REFERENCE: {GROUP}, CUE_TIME: {POINT}, CUE_TRACK: {POINT}, CUE_CLUSTER: {POINT}, SIMPLE: {CLUSTER}, TIMESTAMP: {CLUSTER}}
_TOP = {EBML, SEGMENT}
_ENDED_BY = {SEGMENT: _TOP, CLUSTER: {*_TOP, CLUSTER, CUES, INFO, TRACKS, *_OTHERS}, CUES: {*_TOP, CLUSTER, INFO, TRACKS, *_OTHERS}, TRACKS: {*_TOP, CLUSTER, CUES, INFO, *_OTHERS}, INFO: {*_TOP, CLUSTER, CUES, TRACKS, *_OTHERS}}
#: Open elements, one in another, that a sound file does not reach.
_DEEPEST = 64
_PARENTS = {SEGMENT, TRACKS, CLUSTER, CUES, GROUP, INFO, ENTRY, AUDIO, POINT, POSITIONS}


def _id(i: int) -> bytes:
    return i.to_bytes((i.bit_length() + 7) // 8, "big")


def _size(n: int) -> bytes:
    for width in range(1, 9):
        if n < (1 << 7 * width) - 1:
            return (n | 1 << 7 * width).to_bytes(width, "big")
    raise ValueError("element too large")


def element(i: int, body: bytes) -> bytes:
    return _id(i) + _size(len(body)) + body


def number(i: int, n: int) -> bytes:
    return element(i, n.to_bytes(max(1, (n.bit_length() + 7) // 8), "big"))


_HEAD = element(EBML, number(0x4286, 1) + number(0x42F7, 1) + number(0x42F2, 4) + number(0x42F3, 8) + element(0x4282, b"matroska") + number(0x4287, 4) + number(0x4285, 2))
_TRACKS = element(TRACKS, element(ENTRY, number(NUMBER, 1) + number(UID, 1) + number(KIND, 2) + number(LACING, 1) + element(CODEC, b"A_PCM/INT/LIT") + element(AUDIO, element(SAMPLING, struct.pack(">d", RATE)) + number(CHANNELS, 1) + number(DEPTH, 8))))


def write_matroska(payload: bytes) -> bytes:
    """A file whose frames, joined, are the payload; its length must be a multiple of FRAME."""
    frames, ms = len(payload) // FRAME, FRAME * 1000 // RATE
    info = element(INFO, number(SCALE, 1_000_000) + element(DURATION, struct.pack(">d", float(frames * ms))))
    body, cues, at = [info, _TRACKS], [], len(info) + len(_TRACKS)
    for first in range(0, frames, LACE * BLOCKS):
        cluster = [number(TIMESTAMP, first * ms)]
        for k in range(first, min(frames, first + LACE * BLOCKS), LACE):
            n = min(LACE, frames - k)
            # Track 1, timestamp in the cluster, keyframe; fixed-size lacing where frames share a block.
            head = b"\x81" + struct.pack(">h", (k - first) * ms) + (bytes([0x84, n - 1]) if n > 1 else b"\x80")
            cluster.append(element(SIMPLE, head + payload[k * FRAME : (k + n) * FRAME]))
        data = element(CLUSTER, b"".join(cluster))
        cues.append(element(POINT, number(CUE_TIME, first * ms) + element(POSITIONS, number(CUE_TRACK, 1) + number(CUE_CLUSTER, at))))
        body.append(data)
        at += len(data)
    return _HEAD + element(SEGMENT, b"".join([*body, element(CUES, b"".join(cues))]))


class Packet(NamedTuple):
    track: int
    timestamp_ns: int
    offset: int
    length: int
    keyframe: bool
    cluster: int


class Media:
    """What a file holds: packets, cues as (time, track, cluster offset), tracks, and any damage."""

    def __init__(self, data: bytes | None):
        self.data = data or b""
        self.packets: list[Packet] = []
        self.cues: list[tuple[int, int, int]] = []
        self.tracks: list[dict] = []
        self.scale, self.clusters, self.error = 1_000_000, 0, ""
        self._time, self._segment = 0, 0
        self._key, self._cue = True, [0, 0]
        try:
            self._walk(0, len(self.data))
        except (IndexError, ValueError, struct.error) as broken:
            self.error = str(broken) or type(broken).__name__

    def _vint(self, at: int, keep: bool = False) -> tuple[int, int, int]:
        """(value, next position, width); an id keeps its marker bit."""
        first = self.data[at]
        width = 9 - first.bit_length()
        if width > 8 or at + width > len(self.data):
            raise ValueError(f"no integer at byte {at}")
        raw = int.from_bytes(self.data[at : at + width], "big")
        return (raw if keep else raw & (1 << 7 * width) - 1), at + width, width

    def _walk(self, at: int, end: int) -> None:
        """Goes through the elements with a stack of those that are open."""
        # Kind, end, whether the size is unknown, packets before it, of each open element.
        open_ = [(0, end, False, 0)]
        while True:
            while len(open_) > 1 and at >= open_[-1][1]:
                self._leave(*open_.pop())
            stop = open_[-1][1]
            if at >= stop:
                return
            kind, body, _ = self._vint(at, keep=True)
            # An element of unknown size ends where one comes that cannot be inside it.
            while open_[-1][2] and kind in _ENDED_BY.get(open_[-1][0], ()):
                self._leave(*open_.pop())
            stop = open_[-1][1]
            size, body, width = self._vint(body)
            unknown = size == (1 << 7 * width) - 1
            if unknown and kind not in _PARENTS:
                raise ValueError(f"element {kind:x} of unknown size at byte {at}")
            last = stop if unknown else body + size
            if last > stop:
                if kind not in _PARENTS:
                    raise ValueError(f"element {kind:x} is cut at byte {body}")
                self.error, last = f"element {kind:x} is cut", stop
            self._enter(kind, body, last, {k for k, *_ in open_})
            if kind in _PARENTS:
                if len(open_) > _DEEPEST:
                    raise ValueError(f"elements are nested too deep at byte {at}")
                open_.append((kind, last, unknown, len(self.packets)))
                at = body
            else:
                at = last

    def _leave(self, kind: int, stop: int, unknown: bool, first: int) -> None:
        if kind == GROUP and not self._key:
            # A block that refers to another is no keyframe; the reference may follow the block.
            self.packets[first:] = [p._replace(keyframe=False) for p in self.packets[first:]]

    def _uint(self, at: int, stop: int) -> int:
        return int.from_bytes(self.data[at:stop], "big")

    def _enter(self, kind: int, at: int, stop: int, inside: set[int]) -> None:
        if kind in _PLACES and not inside & _PLACES[kind]:
            raise ValueError(f"element {kind:x} is out of place at byte {at}")
        if kind == SIMPLE:
            self._block(at, stop, None)
        elif kind == BLOCK:
            self._block(at, stop, self._key)
        elif kind == GROUP:
            self._key = True
        elif kind == REFERENCE:
            self._key = False
        elif kind == CLUSTER:
            self.clusters += 1
        elif kind == TIMESTAMP:
            self._time = self._uint(at, stop)
        elif kind == SCALE:
            self.scale = self._uint(at, stop)
        elif kind == ENTRY:
            self.tracks.append({})
        elif kind in (NUMBER, KIND, CHANNELS, DEPTH):
            if self.tracks:
                self.tracks[-1][{NUMBER: "number", KIND: "kind", CHANNELS: "channels", DEPTH: "depth"}[kind]] = self._uint(at, stop)
        elif kind == CODEC and self.tracks:
            self.tracks[-1]["codec"] = self.data[at:stop].decode("latin-1")
        elif kind == POINT:
            self._cue = [0, 0]
        elif kind in (CUE_TIME, CUE_TRACK):
            self._cue[kind == CUE_TRACK] = self._uint(at, stop)
        elif kind == CUE_CLUSTER:
            self.cues.append((self._cue[0] * self.scale, self._cue[1], self._segment + self._uint(at, stop)))
        elif kind == SEGMENT:
            self._segment = at

    def _block(self, at: int, stop: int, key: bool | None) -> None:
        track, at, _ = self._vint(at)
        relative, flags = struct.unpack_from(">hB", self.data, at)
        at += 3
        key = bool(flags & 0x80) if key is None else key
        lacing, count = flags >> 1 & 3, 1
        sizes: list[int] = []
        if lacing:
            count, at = self.data[at] + 1, at + 1
        if lacing == 1:
            for _ in range(count - 1):
                n = 0
                while True:
                    b, at = self.data[at], at + 1
                    n += b
                    if b < 255:
                        break
                sizes.append(n)
        elif lacing == 3:
            for k in range(count - 1):
                n, at, width = self._vint(at)
                # After the first size, differences are stored with half the range taken off.
                sizes.append(n if not k else sizes[-1] + n - ((1 << 7 * width - 1) - 1))
        elif lacing == 2:
            if (stop - at) % count:
                raise ValueError(f"frames of unlike size at byte {at}")
            sizes = [(stop - at) // count] * (count - 1)
        last = stop - at - sum(sizes)
        if last < 0 or min(sizes, default=0) < 0:
            raise ValueError(f"frames exceed their block at byte {at}")
        when = (self._time + relative) * self.scale
        for n in [*sizes, last]:
            self.packets.append(Packet(track, when, at, n, key, self.clusters))
            at += n

    def payload(self, track: int = 1) -> bytes:
        view = memoryview(self.data)
        return b"".join(view[p.offset : p.offset + p.length] for p in self.packets if p.track == track)


def packets(files: DataFrame, column: str, key: str) -> DataFrame:
    """The packet table of a column of files: one row a packet, and one with the error if any."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for k, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                media = Media(data)
                rows += [(k, *p, None) for p in media.packets]
                if media.error:
                    rows.append((k, None, None, None, None, None, None, media.error))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * 8
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names=names)

    names = [key, "track", "timestamp_ns", "offset", "length", "keyframe", "cluster", "error"]
    types = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.string()]
    return files.select(F.col(key).cast("long").alias(key), column).mapInArrow(read, f"`{key}` long, track long, timestamp_ns long, offset long, length long, keyframe boolean, cluster long, error string")


def pad(text: str | None) -> tuple[int, bytes]:
    raw = (text or "").encode()
    return len(raw), raw + b"\xff" * (-len(raw) % FRAME if raw else FRAME)


def features(media: Media, payload: bytes) -> str:
    """Packets, clusters, cues, duration and simple statistics of the samples."""
    samples = np.frombuffer(payload, np.uint8)
    mean, spread = float(samples.mean()), float(samples.std())
    end = max((p.timestamp_ns for p in media.packets), default=0) // 1_000_000 + FRAME * 1000 // RATE
    return f"packets={len(media.packets)} clusters={media.clusters} cues={len(media.cues)} ms={end} mean={mean:.4f} std={spread:.4f}"


_DIGEST = [("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string())]


def store(docs: DataFrame) -> DataFrame:
    """(doc_id, n_bytes, media): each text as a Matroska file."""

    def write(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            padded = [pad(t) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([n for n, _ in padded], pa.int64()), pa.array([write_matroska(p) for _, p in padded], pa.binary())], names=["doc_id", "n_bytes", "media"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(write, "doc_id long, n_bytes long, media binary")


def digest(stored: DataFrame) -> DataFrame:
    """Reads stored files back and gives digests of payload and file, and features."""

    def read(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, n, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                media = Media(data)
                if media.error:
                    raise ValueError(f"document {doc_id}: {media.error}")
                payload = media.payload()
                rows.append((doc_id, n, len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-32:]), len(data), hashlib.sha256(data).hexdigest(), features(media, payload)))
            cols = list(zip(*rows, strict=True)) if rows else [[]] * len(_DIGEST)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(cols, _DIGEST, strict=True)], names=[k for k, _ in _DIGEST])

    return stored.select("doc_id", "n_bytes", "media").mapInArrow(read, ", ".join(f"{k} {'string' if t == pa.string() else 'long'}" for k, t in _DIGEST))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(store(table(spark, sf_dir, "documents")))
