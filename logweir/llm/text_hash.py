"""Vectorised hashes of words and byte strings in concatenated texts."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
_MIX1, _MIX2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_BYTE_TOO = np.random.default_rng(20240301).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_powers: dict[str, np.ndarray] = {}
#: Bytes that are hashed at once.
BATCH = 1 << 18


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base, and of its inverse, modulo 2**64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, BATCH + 1)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A finaliser: spreads every bit of each value."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


def prefix_hash(data: np.ndarray, second: bool = False) -> np.ndarray:
    """Running polynomial hash, or a second independent one; element i covers the first i bytes."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((_BYTE_TOO if second else _BYTE)[data] * up[:-1], out=out[1:])
    return out


def span_hash(prefix: np.ndarray, start: np.ndarray, stop: np.ndarray) -> np.ndarray:
    """Hashes of the byte ranges [start, stop)."""
    _, down = powers(len(prefix))
    return mix((prefix[stop] - prefix[start]) * down[start])


_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True


def word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """Start and hash of each word, a run of other bytes than the six blanks."""
    if len(data) > 2 * BATCH:
        # Cut at a blank; a longer word is hashed whole.
        starts, hashes, at = [], [], 0
        while at < len(data):
            end = min(len(data), at + BATCH)
            while end < len(data) and data[end] not in b"\t\n\x0b\x0c\r ":
                end += 1
            s, h = _word_hashes(data[at:end])
            starts.append(s + at)
            hashes.append(h)
            at = end
        return np.concatenate(starts), np.concatenate(hashes)
    return _word_hashes(data)


def _word_hashes(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    raw = np.frombuffer(data, np.uint8)
    edge = np.diff(np.concatenate([[True], _BLANK[raw], [True]]).astype(np.int8))
    start, stop = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
    return start, span_hash(prefix_hash(raw), start, stop)


_PLACE = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def shingle_sets(texts: list[bytes], width: int = 5) -> list[np.ndarray]:
    """For each text the sorted distinct hashes of its word shingles; A-Z count as a-z.

    A text with fewer words than ``width`` has its whole sequence as its one shingle."""
    out: list[np.ndarray] = []
    i = 0
    while i < len(texts):
        j, size = i, 0
        while j < len(texts) and (j == i or size + len(texts[j]) <= BATCH):
            size += len(texts[j]) + 1
            j += 1
        part = texts[i:j]
        start, word = word_hashes(b" ".join(part).lower())
        bounds = np.searchsorted(start, np.cumsum([0, *(len(t) + 1 for t in part)]))
        shingle = np.zeros(max(0, len(word) - width + 1), np.uint64)
        for k in range(width):
            shingle += word[k : k + len(shingle)] * _PLACE[k % 5]
        shingle = mix(shingle)
        for a, b in zip(bounds[:-1], bounds[1:], strict=True):
            if b - a >= width:
                out.append(np.unique(shingle[a : b - width + 1]))
            elif b > a:
                out.append(mix(np.array([sum((int(w) * int(_PLACE[k % 5]) for k, w in enumerate(word[a:b])), int(b - a)) & (1 << 64) - 1], np.uint64)))
            else:
                out.append(np.zeros(0, np.uint64))
        i = j
    return out
