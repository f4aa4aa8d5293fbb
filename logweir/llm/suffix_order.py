"""The suffix order of a set of texts, from suffix arrays of the dictionary and the parse.

Prefix-free parsing. Rolling-hash triggers of ``GRAM`` bytes cut each text into phrases that overlap
by a trigger; a run of END bytes closes each text and is a trigger too. As every phrase ends at a
trigger and holds none inside, no suffix of a phrase that is longer than a trigger is a proper prefix
of another's. So a suffix of the texts sorts first by the rest of its phrase, whose rank is looked up
in the suffix array of the dictionary of distinct phrases, and then by the phrases that follow, whose
rank is that of the next position in the suffix array of the parse. Repeated text is sorted once.

Both arrays come from prefix doubling, vectorised; ranks are exact up to ``depth`` bytes, which is all
that is asked. END must not occur in the texts: UTF-8 has no byte 255.
"""

from __future__ import annotations

import numpy as np

from logweir.llm.text_hash import mix

GRAM, EVERY, END = 8, 16, 255
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _dense(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Ranks from 0, equal where keys are equal, and their number."""
    order = np.argsort(keys)
    new = np.diff(keys[order], prepend=keys[order[:1]]) != 0
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(new)
    return rank, int(new.sum()) + 1 if len(order) else 0


def _doubled(keys: np.ndarray, stop: np.ndarray, width: int, depth: int) -> np.ndarray:
    """Prefix doubling: ranks (from 1) of keys that cover ``width`` items, until they cover ``depth``.

    ``stop`` is the end of each item's sequence; what lies behind counts as 0."""
    here = np.arange(len(keys))
    rank, classes = _dense(keys)
    while width < depth and classes < len(keys):
        after = here + width
        inside = after < stop
        second = np.where(inside, rank[np.where(inside, after, 0)] + 1, 0)
        rank, now = _dense(rank * (classes + 1) + second)
        if now == classes:
            break
        classes, width = now, 2 * width
    return rank + 1


def parse(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The texts with their ends in one array, the starts and ends of texts in it, starts of phrases."""
    raw = np.frombuffer(b"".join(t + bytes([END]) * GRAM for t in texts), np.uint8)
    sizes = np.array([len(t) for t in texts])
    begin = np.cumsum(sizes + GRAM) - sizes - GRAM
    roll = np.zeros(len(raw) - GRAM + 1, np.uint64)
    for k in range(GRAM):
        roll = roll * _BASE + raw[k : k + len(roll)]
    mark = (mix(roll) & np.uint64(EVERY - 1)) == 0
    for end in range(GRAM):
        # Positions of the END run start no phrase.
        at = begin + sizes + end
        mark[at[at < len(mark)]] = False
    mark[begin[sizes > 0]] = True
    return raw, begin, begin + sizes, np.flatnonzero(mark)


def suffix_order(texts: list[bytes], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All suffixes of at least ``depth`` bytes, in order of their first ``depth`` bytes: the text and
    the start of each, and whether these bytes equal those of the suffix before."""
    raw, begin, end, starts = parse(texts)
    of = np.searchsorted(begin, starts, "right") - 1
    next_start = np.append(starts[1:], len(raw))
    stop = np.minimum(next_start, end[of])
    whole = raw.tobytes()
    phrases = [whole[a : b + GRAM] for a, b in zip(starts.tolist(), stop.tolist(), strict=True)]
    # The dictionary in order, and the parse as ranks in it.
    words = sorted(set(phrases))
    place = {w: i for i, w in enumerate(words)}
    ranks = np.array([place[p] for p in phrases], np.int64)
    # Suffix array of the dictionary: seven bytes at a time in base 257, 0 behind the end.
    lengths = np.array([len(w) for w in words])
    first = np.cumsum(lengths) - lengths
    letters = np.frombuffer(b"".join(words), np.uint8).astype(np.int64) + 1
    last = np.repeat(first + lengths, lengths)
    here, key = np.arange(len(letters)), np.zeros(len(letters), np.int64)
    for k in range(7):
        inside = here + k < last
        key = key * 257 + np.where(inside, letters[np.where(inside, here + k, 0)], 0)
    dictionary = _doubled(key, last, 7, min(depth, int(lengths.max(initial=0))))
    # Suffix array of the parse: a phrase advances by a byte at least.
    many = len(ranks)
    close = np.searchsorted(of, of, "right")
    order = _doubled(ranks, close, 1, depth)
    follows = np.arange(1, many + 1)
    follow = np.where(follows < close, order[np.minimum(follows, many - 1)], 0) if many else order
    # Merge: rank of the rest of the phrase, then rank of what follows.
    asked = np.maximum(0, end - begin - depth + 1)
    text = np.repeat(np.arange(len(texts)), asked)
    start = np.arange(asked.sum()) - np.repeat(np.cumsum(asked) - asked, asked)
    position = begin[text] + start
    phrase = np.searchsorted(starts, position, "right") - 1
    rest = dictionary[first[ranks[phrase]] + position - starts[phrase]]
    by = np.argsort(rest * (many + 1) + follow[phrase], kind="stable")
    position = position[by]
    same = np.zeros(len(by), bool)
    windows = np.lib.stride_tricks.sliding_window_view(raw, depth) if len(raw) >= depth else np.zeros((0, depth), np.uint8)
    for a in range(1, len(by), 1 << 14):
        b = min(len(by), a + (1 << 14))
        same[a:b] = (windows[position[a:b]] == windows[position[a - 1 : b - 1]]).all(axis=1)
    return text[by], start[by], same
