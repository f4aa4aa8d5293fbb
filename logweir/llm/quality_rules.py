"""Quality rules: a linear-chain conditional random field marks the lines of a text as content or
boilerplate, and the share of content decides whether the text is kept.

Base rules come first: a text with few words, or with many words in runs of three that it repeats, fails.
The rest is the field's verdict. A line gives binary features of its shape alone: its length, capitals,
signs, digits, end, words that repeat within it or stand in repeated runs, and whether it is a copy. No word
is a feature, so the model knows no language. A Viterbi pass labels the lines of a text together; it
is kept if at least ``SHARE`` of its words lie in lines of content.

Training. Only texts are labelled (``labels.quality``), not lines. All lines of a text start with
its label; the field is fitted, its own decoding relabels the lines, and it is fitted again.
A text whose decoding contradicts its label keeps the label on all its lines. At most ``SAMPLE`` texts of each
label, those with the least hashes of doc_id among those whose crc32(doc_id) mod 3 is not 1, and at most
``LINES`` lines of each, from a place that a hash chooses, are used. The driver sees their features, a
bounded number of small integers. Everything else, all rules and labels of lines, covers whole texts
where they lie, in Arrow batches, without a shuffle.

Words are compared by 64-bit hashes, within one text only.

Edge cases. A null text has no words and fails. Where the labelled rows lack one of the two labels there
is nothing to learn, every line is content, and the base rules decide. A doc_id labelled twice is good if
all its labels are. Null labels and null doc_ids are not learnt from. Repeated rows are judged alike. Extra
columns pass through ``judged`` untouched. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import least_hashes, table
from logweir.llm.text_hash import BATCH, mix, word_hashes
from logweir.llm.toxicity import held_out

#: Least words; most percent of words in repeated runs; least share of words in content.
LEAST_WORDS, MOST_REPEATED, SHARE = 50, 50, 0.5
#: Texts of each label that the field is fitted to, and lines of each.
SAMPLE, LINES = 1500, 200
CONTENT, BOILERPLATE = 0, 1
BASE = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean"

_BLANKS = b"\t\n\x0b\x0c\r "


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_CAPITAL, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_LETTER = _class(bytes([*range(65, 91), *range(97, 123), *range(0xC0, 0x100)]))
_SYMBOL, _PAUSE, _LOUD = _class(b"[#*$%&|<>]"[1:-1]), _class(b".,;:"), _class(b"!?")
_LATER, _BLANK = _class(bytes(range(0x80, 0xC0))), _class(_BLANKS)
_ENDS = _class(b".!?")

#: Bounds of the features that are true above a bound, by what is measured on a line.
BOUNDS = {
    "words": (0, 2, 5, 12, 30), "capitals": (0.15, 0.4, 0.7), "symbols": (0.01, 0.05, 0.15), "pauses": (0.02, 0.06), "loud": (0.005, 0.04),
    "digits": (0.05, 0.2), "word length": (3.0, 6.0, 9.0), "same as before": (0.1, 0.5), "distinct": (0.4, 0.7, 0.95), "repeated": (0.2, 0.6),
}
FEATURES = ["bias", *(f"{k} > {b}" for k, bounds in BOUNDS.items() for b in bounds), "ends", "copy", "first", "last"]


class Measured:
    """Lines of several texts at once: base counts by text, features and words by line."""

    def __init__(self, texts: list[bytes]):
        joined = b"\n".join(texts)
        raw = np.frombuffer(joined, np.uint8)
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        begin = np.cumsum(size + 1) - (size + 1)
        # Lines: where they begin and end, and whose they are.
        ends = np.append(np.flatnonzero(raw == 10), len(raw))
        starts = np.append(0, ends[:-1] + 1)
        owner = np.searchsorted(begin, starts, "right") - 1
        self.first_line = np.searchsorted(owner, np.arange(len(texts) + 1))
        self.n_lines = len(starts)

        def per(mask: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
            sums = np.concatenate([[0], np.cumsum(mask[raw])])
            return sums[b] - sums[a]

        at, hashes = word_hashes(joined)
        of_text = np.searchsorted(begin, at, "right") - 1
        of_line = np.searchsorted(starts, at, "right") - 1
        self.words = np.bincount(of_line, minlength=len(starts))
        n = len(texts)
        stop = begin + size
        later, blank = per(_LATER, begin, stop), per(_BLANK, begin, stop)
        self.n_words = np.bincount(of_text, minlength=n)
        self.word_chars = size - later - blank
        self.n_symbols = per(_SYMBOL, begin, stop)
        repeated = self._repeated(hashes, of_text)
        self.n_repeat_words = np.bincount(of_text[repeated], minlength=n)
        copy = self._copies(texts)
        self.n_dup_lines = np.add.reduceat(np.append(copy, 0), self.first_line[:-1]) if n else np.zeros(0, np.int64)
        # Shares of a line's letters, characters or words; an empty line has none.
        chars = np.maximum(1, ends - starts - per(_LATER, starts, ends) - per(_BLANK, starts, ends))
        letters, count = np.maximum(1, per(_LETTER, starts, ends)), np.maximum(1, self.words)
        same = np.zeros(len(hashes), bool)
        same[1:] = (hashes[1:] == hashes[:-1]) & (of_line[1:] == of_line[:-1])
        by_line = lambda which: np.bincount(of_line[which], minlength=len(starts))
        last = np.zeros(len(starts), bool)
        if len(raw):
            stripped = np.maximum.accumulate(np.where(_BLANK[raw], -1, np.arange(len(raw))))
            final = stripped[np.maximum(ends - 1, 0)]
            last = (final >= starts) & (ends > starts) & _ENDS[raw[np.maximum(final, 0)]]
        measures = {
            "words": self.words, "capitals": per(_CAPITAL, starts, ends) / letters, "symbols": per(_SYMBOL, starts, ends) / chars, "pauses": per(_PAUSE, starts, ends) / chars,
            "loud": per(_LOUD, starts, ends) / chars, "digits": per(_DIGIT, starts, ends) / chars, "word length": chars / count, "same as before": by_line(same) / count,
            "distinct": by_line(self._first_in(hashes, of_line)) / count, "repeated": by_line(repeated) / count,
        }
        position = np.arange(len(starts))
        columns = [np.ones(len(starts), bool)]
        columns += [measures[k] > b for k, bounds in BOUNDS.items() for b in bounds]
        columns += [last, copy.astype(bool), position == self.first_line[owner], position == self.first_line[owner + 1] - 1]
        self.features = np.column_stack(columns).astype(np.uint8)
        self.base_failed = (self.n_words < LEAST_WORDS) | (100 * self.n_repeat_words > MOST_REPEATED * self.n_words)

    @staticmethod
    def _repeated(hashes: np.ndarray, of_text: np.ndarray) -> np.ndarray:
        """Words in runs of three that their text holds twice or more."""
        out = np.zeros(len(hashes), bool)
        if len(hashes) < 3:
            return out
        h = hashes.astype(np.uint64)
        run = mix(h[:-2] * np.uint64(0x9E3779B97F4A7C15) + mix(h[1:-1]) * np.uint64(0xA0761D6478BD642F) + mix(mix(h[2:])) * np.uint64(0xE7037ED1A0B428DB))
        run = mix(run + of_text[:-2].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
        whole = np.flatnonzero(of_text[:-2] == of_text[2:])
        order = whole[np.argsort(run[whole], kind="stable")]
        same = run[order[1:]] == run[order[:-1]]
        twice = order[np.concatenate([[False], same]) | np.concatenate([same, [False]])] if len(order) else order
        for k in range(3):
            out[twice + k] = True
        return out

    @staticmethod
    def _first_in(hashes: np.ndarray, group: np.ndarray) -> np.ndarray:
        """The first of equal words of a line."""
        order = np.lexsort((hashes, group))
        first = np.ones(len(order), bool)
        first[1:] = (hashes[order[1:]] != hashes[order[:-1]]) | (group[order[1:]] != group[order[:-1]])
        out = np.zeros(len(order), bool)
        out[order] = first
        return out

    @staticmethod
    def _copies(texts: list[bytes]) -> np.ndarray:
        """1 for lines with a word that equal an earlier one of their text."""
        out: list[int] = []
        for text in texts:
            seen: set[bytes] = set()
            for line in text.split(b"\n"):
                if not line.strip(_BLANKS):
                    out.append(0)
                    continue
                out.append(line in seen)
                seen.add(line)
        return np.array(out, np.int64)


def measured(texts: Iterable[str | None]) -> Iterator[Measured]:
    """``texts`` in groups of a bounded size, in order; a longer text is its own group."""
    held: list[bytes] = []
    size = 0
    for text in texts:
        data = (text or "").encode("utf-8", "replace")
        if held and size + len(data) > BATCH:
            yield Measured(held)
            held, size = [], 0
        held.append(data)
        size += len(data) + 1
    if held:
        yield Measured(held)


class Field:
    """A linear chain over two labels: weights of the features, of the first label and of steps.

    All weights speak for BOILERPLATE against CONTENT; ``steps[a, b]`` is for b after a."""

    def __init__(self, weights: np.ndarray, start: float, steps: np.ndarray):
        self.weights, self.start, self.steps = weights, float(start), steps

    def decode(self, features: np.ndarray) -> np.ndarray:
        """The likeliest labels of one text's lines; of two alike, content."""
        scores = (features @ self.weights).tolist()
        (aa, ab), (ba, bb) = self.steps.tolist()
        back: list[tuple[int, int]] = []
        zero, one = 0.0, self.start + scores[0]
        for s in scores[1:]:
            to_zero, to_one = zero + aa >= one + ba, zero + ab >= one + bb
            back.append((0 if to_zero else 1, 0 if to_one else 1))
            zero, one = (zero + aa if to_zero else one + ba), (zero + ab if to_one else one + bb) + s
        label = 1 if one > zero else 0
        out = [label]
        for pair in reversed(back):
            label = pair[label]
            out.append(label)
        return np.array(out[::-1], np.int8)


def _likelihood(theta: np.ndarray, x: np.ndarray, y: np.ndarray, at: np.ndarray, there: np.ndarray, ridge: float) -> tuple[float, np.ndarray]:
    """Negative log-likelihood a line, with its gradient.

    x: features of all lines; y: labels; at, there: (step, text) index of lines and whether there is one."""
    k = x.shape[1]
    w, start, steps = theta[:k], theta[k], theta[k + 1 :].reshape(2, 2)
    e = (x @ w)[at] * there
    n_steps, n = at.shape
    alpha, beta = np.zeros((n_steps, n, 2)), np.zeros((n_steps, n, 2))
    alpha[0, :, 1] = start + e[0]
    for t in range(1, n_steps):
        new = np.logaddexp(alpha[t - 1, :, 0, None] + steps[0], alpha[t - 1, :, 1, None] + steps[1])
        new[:, 1] += e[t]
        alpha[t] = np.where(there[t][:, None], new, alpha[t - 1])
    log_z = np.logaddexp(alpha[-1, :, 0], alpha[-1, :, 1])
    for t in range(n_steps - 2, -1, -1):
        ahead = beta[t + 1] + np.stack([np.zeros(n), e[t + 1]], axis=1)
        new = np.logaddexp(steps[:, 0] + ahead[:, 0, None], steps[:, 1] + ahead[:, 1, None])
        beta[t] = np.where(there[t + 1][:, None], new, beta[t + 1])
    p = np.exp(alpha + beta - log_z[None, :, None]) * there[:, :, None]
    labels = y[at] * there
    both = there[1:] & there[:-1]
    gradient = np.zeros_like(theta)
    line = np.zeros(len(x))
    line[at[there]] = p[:, :, 1][there] - labels[there]
    gradient[:k] = line @ x
    gradient[k] = (p[0, :, 1] - labels[0]).sum()
    score = (e * labels).sum() + start * labels[0].sum()
    for a in (0, 1):
        for b in (0, 1):
            joint = alpha[:-1, :, a] + steps[a, b] + beta[1:, :, b] + (e[1:] if b else 0.0) - log_z[None]
            met = both & (labels[:-1] == a) & (labels[1:] == b)
            gradient[k + 1 + 2 * a + b] = np.exp(joint[both]).sum() - met.sum()
            score += steps[a, b] * met.sum()
    m = max(1, len(x))
    return (log_z.sum() - score) / m + ridge * theta @ theta / 2, gradient / m + ridge * theta


def _minimum(f, theta: np.ndarray, rounds: int = 60, memory: int = 8) -> np.ndarray:
    """Limited-memory quasi-Newton steps with halving."""
    value, gradient = f(theta)
    past: list[tuple[np.ndarray, np.ndarray]] = []
    for _ in range(rounds):
        step, kept = gradient.copy(), []
        for s, d in reversed(past):
            a = s @ step / (s @ d)
            kept.append(a)
            step -= a * d
        if past:
            s, d = past[-1]
            step *= s @ d / (d @ d)
        for (s, d), a in zip(past, reversed(kept), strict=True):
            step += s * (a - d @ step / (s @ d))
        size = 1.0 if past else min(1.0, 1.0 / max(1e-12, abs(gradient).sum()))
        while size > 1e-8:
            there, (new, slope) = theta - size * step, f(theta - size * step)
            if new <= value - 1e-4 * size * (step @ gradient):
                break
            size /= 2
        else:
            break
        s, d = there - theta, slope - gradient
        if s @ d > 1e-12:
            past = [*past, (s, d)][-memory:]
        done = abs(value - new) < 1e-7
        theta, value, gradient = there, new, slope
        if done:
            break
    return theta


def fit_field(texts: list[np.ndarray], labels: list[np.ndarray], *, ridge: float = 1e-3) -> Field:
    """Fits the field to features and labels of the lines of each text."""
    sizes = np.array([len(t) for t in texts])
    x, y = np.concatenate(texts).astype(float), np.concatenate(labels).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    step = np.arange(sizes.max())[:, None]
    there = step < sizes[None]
    at = np.where(there, first[None] + step, 0)
    k = x.shape[1]
    theta = _minimum(lambda v: _likelihood(v, x, y, at, there, ridge), np.zeros(k + 5))
    return Field(theta[:k], theta[k], theta[k + 1 :].reshape(2, 2))


def content_share(labels: np.ndarray, words: np.ndarray) -> float:
    """Share of words in lines of content; 1 where there are no words."""
    total = int(words.sum())
    return float(words[labels == CONTENT].sum()) / total if total else 1.0


def train(texts: list[np.ndarray], words: list[np.ndarray], bad: list[bool]) -> Field | None:
    """A field from features and words of lines, and whether each text is of low quality."""
    if len(set(bad)) < 2:
        return None
    given = [np.full(len(t), BOILERPLATE if b else CONTENT) for t, b in zip(texts, bad, strict=True)]
    field = fit_field(texts, given)
    labels = []
    for t, w, g, b in zip(texts, words, given, bad, strict=True):
        own = field.decode(t)
        labels.append(own if (content_share(own, w) < SHARE) == b else g)
    return fit_field(texts, labels)


def fit(docs: DataFrame, labels: DataFrame, *, sample: int = SAMPLE, lines: int = LINES) -> Field | None:
    """A field fitted to a bounded sample of the labelled texts that are not held out."""
    spark = docs.sparkSession
    one = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").alias("good")).withColumn("h", F.xxhash64("doc_id"))
    picked = [least_hashes(one.where((F.col("good") > 0) == good), "h", sample).select("doc_id", "good") for good in (True, False)]
    # At most 2 * sample rows of two integers.
    rows = [(int(r["doc_id"]), int(r["good"] > 0)) for r in picked[0].union(picked[1]).collect()]
    if len({g for _, g in rows}) < 2:
        return None
    chosen = F.broadcast(spark.createDataFrame(sorted(rows), "doc_id long, good int"))

    def measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, goods = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            i = 0
            for group in measured(batch.column(1).to_pylist()):
                for k in range(len(group.n_words)):
                    a, b = group.first_line[k : k + 2]
                    if b - a > lines:
                        a += (ids[i] * 0x9E3779B1 >> 5) % (b - a - lines + 1)
                        b = a + lines
                    yield pa.RecordBatch.from_arrays([pa.array([c], t) for c, t in ((ids[i], pa.int64()), (goods[i], pa.int32()), (group.features[a:b].tobytes(), pa.binary()), (group.words[a:b].astype("<i4").tobytes(), pa.binary()))], names=["doc_id", "good", "features", "words"])
                    i += 1

    # One row for each distinct text under an id, so that the sample stays bounded where ids repeat.
    found = docs.select("doc_id", "text").join(chosen, "doc_id").mapInArrow(measure, "doc_id long, good int, features binary, words binary").groupBy("doc_id").agg(F.min(F.struct("good", "features", "words")).alias("r"))
    got = sorted(found.select("doc_id", "r.*").collect())
    texts = [np.frombuffer(bytes(r["features"]), np.uint8).reshape(-1, len(FEATURES)) for r in got]
    return train(texts, [np.frombuffer(bytes(r["words"]), "<i4") for r in got], [not r["good"] for r in got]) if got else None


def judged(docs: DataFrame, field: Field | None) -> DataFrame:
    """``docs`` with the columns of ``BASE``, content_share double and kept boolean."""
    at = docs.columns.index("text")
    added = T.StructType.fromDDL(BASE + ", content_share double, kept boolean")
    taken = set(docs.columns) & set(added.names)
    if taken:
        raise ValueError(f"columns that the rules add are there already: {sorted(taken)}")
    out = T.StructType([*docs.schema.fields, *added.fields])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base: list[list[np.ndarray]] = []
            shares: list[float] = []
            for group in measured(batch.column(at).to_pylist()):
                base.append([group.n_words, group.word_chars, group.n_symbols, group.n_dup_lines, group.n_repeat_words, group.base_failed])
                for a, b in zip(group.first_line[:-1], group.first_line[1:], strict=True):
                    shares.append(1.0 if field is None else content_share(field.decode(group.features[a:b]), group.words[a:b]))
            columns = [np.concatenate(c) for c in zip(*base, strict=True)] if base else [np.zeros(0, np.int64)] * 5 + [np.zeros(0, bool)]
            share = np.array(shares, float)
            kept = ~columns[5].astype(bool) & (share >= SHARE)
            arrays = [*batch.columns, *(pa.array(c) for c in columns), pa.array(share), pa.array(kept)]
            yield pa.RecordBatch.from_arrays(arrays, names=[*batch.schema.names, *added.names])

    return docs.mapInArrow(judge, out)


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = judged(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "content_share")
