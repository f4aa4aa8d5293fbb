"""Suffix order against sorting, and the rounds of repeated substrings against counting windows."""

import random
from collections import Counter

import numpy as np
import pytest

from logweir.llm import suffix_dedup
from logweir.llm.suffix_order import suffix_order


@pytest.mark.parametrize("seed", range(40))
def test_suffix_order_is_sorted(seed):
    rng = random.Random(seed)
    letters = [97, 98] if seed % 3 == 0 else list(range(97, 97 + rng.choice([1, 3, 20])))
    source = bytes(rng.choices(letters, k=400))
    texts = []
    for _ in range(rng.randint(1, 12)):
        a = rng.randrange(300)
        texts.append(source[a : a + rng.randint(0, 150)] + bytes(rng.choices(letters, k=rng.choice([0, 0, 30]))))
    depth = rng.choice([1, 5, 20, 60])
    text, start, same = suffix_order(texts, depth)
    got = [texts[i][j : j + depth] for i, j in zip(text, start, strict=True)]
    assert got == sorted(t[j : j + depth] for t in texts for j in range(len(t) - depth + 1))
    assert same.tolist() == [k > 0 and got[k] == got[k - 1] for k in range(len(got))]


class Chunk:
    def __init__(self, texts):
        self.texts, self.answers = texts, {}

    def codes(self, kind):
        return np.frombuffer(self.answers.get(kind, b""), np.uint8)


def rounds(chunks, bits, length):
    steps = ((1, suffix_dedup.Parse.ask_parse, suffix_dedup.answer_parse), (2, suffix_dedup.Parse.ask_order, suffix_dedup.answer_order(length)))
    for kind, ask, answer in steps:
        buckets = {}
        for c in chunks:
            for b, question in ask(suffix_dedup.Parse(c, length), bits):
                buckets.setdefault(b, []).append((c, question))
        for b in sorted(buckets):
            for (c, _), reply in zip(buckets[b], answer([q for _, q in buckets[b]]), strict=True):
                c.answers[kind] = c.answers.get(kind, b"") + reply
    return [suffix_dedup.Parse(c, length).repeated() for c in chunks]


@pytest.mark.parametrize("hot", [4096, 2, 0])
@pytest.mark.parametrize("seed", range(10))
def test_rounds_find_repeated_windows(seed, hot, monkeypatch):
    """Whether an anchor's phrases are sorted or, beyond HOT texts, met by window."""
    monkeypatch.setattr(suffix_dedup, "HOT", hot)
    monkeypatch.setattr(suffix_dedup, "SORTED_BYTES", 3000)
    rng = random.Random(seed)
    letters = list(range(97, 97 + rng.choice([1, 2, 26])))
    passages = [bytes(rng.choices(letters, k=rng.choice([150, 250, 600]))) for _ in range(5)]
    texts = {b"".join(rng.choice([rng.choice(passages), bytes(rng.choices(range(97, 123), k=rng.randint(1, 120)))]) for _ in range(rng.randint(1, 6))) for _ in range(40)}
    texts = sorted(texts)
    chunks = [Chunk(texts[i::3]) for i in range(3)] + [Chunk([])]
    seen = Counter(t[k : k + 200] for t in texts for k in range(len(t) - 199))
    for chunk, runs in zip(chunks, rounds(chunks, 4, 200), strict=True):
        got = [(t, s) for t, a, b in zip(*(x.tolist() for x in runs), strict=True) for s in range(a, b + 1)]
        assert sorted(got) == [(i, k) for i, t in enumerate(chunk.texts) for k in range(len(t) - 199) if seen[t[k : k + 200]] > 1]
