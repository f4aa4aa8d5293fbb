"""Packing: best-fit decreasing over open windows, after overlong documents are cut.

Plan. One pass over the texts tokenises them where they lie and emits only piece digests (or the
ids themselves, on request): a document's ids and a closing id are cut into full windows and one
rest. Full windows are sequences of their own. Piece rows then go to groups of about
``GROUP_PIECES`` pieces each, by a hash of their row number, and each group is packed alone by
best-fit decreasing: pieces in falling length, each into the open window with the least room that
takes it. A segment tree over the room left, 0..window, finds that window in a dozen steps. A
group's memory is fixed, and only its last windows may be loosely filled.

Tokenising. A text of ordinary Latin characters splits at white space, and no token of this
vocabulary spans white space, so ids are computed by distinct word, by the tokenizer or, for words
of letters, by the same merges in a faster library, and kept for the words met lately. Any other text, and any that
may hold a special token, goes to the tokenizer whole.

Edge cases. A null or empty text is the closing id alone. Repeated rows and null doc_ids are packed
as separate documents. Ties in length go by doc_id, start and row. An empty table gives an empty
result. Extra columns are not read.
"""

from __future__ import annotations

import json
import re
import zlib
from array import array
from collections.abc import Callable, Iterable, Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import Recent, slices, table

WINDOW, END_ID = 4096, 2
#: Pieces in one packing group, on average.
GROUP_PIECES = 32_768
TOKENIZER = "word_bpe_49k.json"
#: Distinct words of a generation (``Recent``) whose ids a worker keeps.
CACHE_WORDS = 200_000
#: Anything else than ASCII text and plain Latin letters, whose case and composition are settled.
_OTHER = re.compile("[^\\x09-\\x0d\\x20-\\x7e\\u00c0-\\u0100\\u0101-\\u012f\\u0131-\\u0148\\u014a-\\u017e]|<\\|")


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _word_merger(path: str) -> Callable[[bytes], list[int]] | None:
    """Byte-pair merging of one word, several times faster than the tokenizer's own.

    Usable where ids rise with the order of merges and all bytes are in the vocabulary: a merge by
    lowest id is then a merge by earliest rule. The end of a word is marked by byte 255, which no
    UTF-8 text holds, so that its last character and the mark merge first, as they should."""
    import tiktoken

    model = json.loads(Path(path).read_text())["model"]
    vocabulary, merges = model["vocab"], [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
    order = [vocabulary[a + b] for a, b in merges]
    end = model.get("end_of_word_suffix") or ""
    if model["type"] != "BPE" or not end or order != sorted(set(order)):
        return None
    # The format writes bytes as visible characters: itself where it is one, else 256 and up in turn.
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    byte = {chr(b): b for b in visible} | {chr(256 + n): b for n, b in enumerate(b for b in range(256) if b not in visible)}
    ranks = {}
    for token, i in vocabulary.items():
        closed = token.endswith(end) and token != end
        raw = token.removesuffix(end) if closed else token
        if all(c in byte for c in raw):
            ranks[bytes(byte[c] for c in raw) + b"\xff" * closed] = i
    if not all(bytes([b]) in ranks for b in range(256)):
        return None
    return tiktoken.Encoding("words", pat_str=".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Encoder:
    """Texts to ids, as little-endian 32-bit words; keeps the ids of words it has met."""

    _by_path: dict[str, "Encoder"] = {}

    def __init__(self, path: str):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        self.tokenizer, self.known = Tokenizer.from_file(path), Recent(CACHE_WORDS)
        self.merge = _word_merger(path)

    @classmethod
    def of(cls, path: str) -> "Encoder":
        if path not in cls._by_path:
            cls._by_path[path] = cls(path)
        return cls._by_path[path]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _learn(self, new: Iterable[str]) -> None:
        """Adds words: letters, letters before closing marks, and others as they are."""
        stems = {w: w.rstrip(".,!?") for w in new}
        marks = self.known.absent({m for w, s in stems.items() if (m := w[len(s) :])})
        odd = [w for w, s in stems.items() if not s.isalpha()]
        self.known.update(zip([*marks, *odd], self._ids([*marks, *odd]), strict=True) if marks or odd else ())
        plain = self.known.absent({s for s in stems.values() if s.isalpha()})
        if self.merge is None:
            self.known.update(zip(plain, self._ids(plain), strict=True) if plain else ())
        else:
            for w in plain:
                self.known[w] = array("I", self.merge(w.encode() + b"\xff")).tobytes()
        known = self.known
        for w, s in stems.items():
            if w not in known:
                known[w] = known[s] + known[w[len(s) :]]

    def encode(self, text: str | None) -> bytes:
        if not text:
            return b""
        if _OTHER.search(text):
            return self._ids([text])[0]
        words = text.lower().split()
        self.known.age()
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            self._learn(self.known.absent(set(words)))
        return b"".join(map(self.known.__getitem__, words))


_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long"


def pieces(docs: DataFrame, path: str, *, window: int = WINDOW, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """One row a piece: full windows of each document and its rest, with a row number ``__uid``."""
    end = np.array([end_id], "<u4").tobytes()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder.of(path)
        for batch in slices(batches):
            rows: list[tuple] = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                ids = encoder.encode(text) + end
                n = len(ids) // 4
                for start in range(0, n, window):
                    part = ids[4 * start : 4 * (start + window)]
                    rows.append((doc_id, start, len(part) // 4, zlib.crc32(part), n, *([part] if with_ids else [])))
            cols = list(zip(*rows, strict=True)) if rows else [[] for _ in range(5 + with_ids)]
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary() if k == "ids" else pa.int64()) for k, c in zip(names, cols, strict=True)], names=names)

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES + ", ids binary" * with_ids)
    return out.withColumn("__uid", F.monotonically_increasing_id())


class RoomTree:
    """Segment tree over the room left in open windows; a leaf holds the windows with that room."""

    def __init__(self, window: int):
        self.leaves = 1 << window.bit_length()
        self.held = [0] * (2 * self.leaves)
        self.open: list[list[int]] = [[] for _ in range(window + 1)]

    def _add(self, room: int, by: int) -> None:
        node = self.leaves + room
        while node:
            self.held[node] += by
            node >>= 1

    def put(self, room: int, index: int) -> None:
        self.open[room].append(index)
        self._add(room, 1)

    def take(self, length: int) -> tuple[int, int] | None:
        """The open window with the least room of at least ``length``, removed from the tree."""
        node = self.leaves + length
        if not self.held[node]:
            while node > 1 and (node & 1 or not self.held[node + 1]):
                node >>= 1
            if node == 1:
                return None
            node += 1
            while node < self.leaves:
                node = 2 * node if self.held[2 * node] else 2 * node + 1
        room = node - self.leaves
        self._add(room, -1)
        return room, self.open[room].pop()


def best_fit(lengths: np.ndarray, window: int) -> tuple[np.ndarray, np.ndarray]:
    """(window index, offset) of each piece; ``lengths`` must not rise."""
    tree, where, offset, count = RoomTree(window), np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64), 0
    for i, n in enumerate(lengths.tolist()):
        found = tree.take(n) if n < window else None
        room, index = found or (window, count)
        count += found is None
        where[i], offset[i] = index, window - room
        if room > n:
            tree.put(room - n, index)
    return where, offset


def pack(docs: DataFrame, path: str | None = None, *, window: int = WINDOW, end_id: int = END_ID, group_pieces: int = GROUP_PIECES, with_ids: bool = False) -> DataFrame:
    """One row a piece, with the sequence that holds it and its offset there."""
    path = path or tokenizer_path()
    if with_ids:
        # A piece then carries its ids, 16 kB for a full window of 4096.
        group_pieces = max(1, group_pieces * 64 // window)
    count, size = docs.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    # A document has one rest at most, and a token one byte at least: both kinds of groups are bounded.
    rests, whole = (max(1, -(-n // group_pieces)) for n in (count, size // window))
    cut = pieces(docs, path, window=window, end_id=end_id, with_ids=with_ids)
    # Full windows need no partner: they are dealt evenly, apart from the rests, however long a document is.
    own = F.xxhash64("__uid")
    cut = cut.withColumn("__group", F.when(F.col("length") < window, F.pmod(own, F.lit(rests))).otherwise(F.lit(rests) + F.pmod(own, F.lit(whole))))
    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", *["ids"] * with_ids]

    def place(key, rows):
        order = [("length", "descending"), ("doc_id", "ascending"), ("start", "ascending"), ("__uid", "ascending")]
        rows = rows.sort_by(order)
        where, offset = best_fit(rows.column("length").to_numpy(), window)
        return rows.select(names).append_column("sequence_id", pa.array((int(key[0].as_py()) << 32) + where)).append_column("offset", pa.array(offset))

    return cut.groupBy("__group").applyInArrow(place, _PIECES + ", ids binary" * with_ids + ", sequence_id long, offset long")


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"))
