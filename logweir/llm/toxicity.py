"""Toxicity: class-conditional Kneser-Ney models of expressions, compared by likelihood ratio.

Model. Each class, toxic and ordinary, has a Kneser-Ney model of the bytes of a word between word
marks. Its longest contexts use the class's own counts; what they discount goes to one
backoff model, built from continuation counts of both classes together, so an expression that
neither class has seen often is judged alike by both and its ratio stays near nought.

Score. The log-likelihoods of a run of words under both classes are summed, and their difference is
divided by the run's length in bytes. This is taken for the whole text and for each run of ``PASSAGE``
words, of which the highest, and the highest apart from it, stand for the text: an insult must not get
lost in a long text around it. A logistic curve of these three normalised differences, fitted to those
that halves of the labelled rows give each other, is the score.

Fitting counts words and n-grams of all labelled rows whose crc32(doc_id) mod 3 is not 1. Spark sums
them; the driver sees a number and a count for each distinct n-gram of a class, which grow with what
the corpus holds, and the tables they give are broadcast. Only the logistic curve uses a bounded
sample: the ``SAMPLE`` smallest hashes of doc_id in each class of those rows. Texts that are not held
out are shuffled once, to meet their labels in a merge join. Scoring reads every whole text where it
lies, in Arrow batches, without a shuffle.

Edge cases. A null or blank text scores by the curve at zero evidence. A doc_id labelled twice is
toxic if any row says so. Null labels and null doc_ids are not learnt from; null doc_ids are scored
and are never held out. Without labelled rows of both classes every score is 0. Repeated rows score
alike. Extra columns pass through ``scored`` untouched; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from logweir.llm.common import Recent, least_hashes, slices, table

#: Labelled rows of each class that the curve is fitted to; the longest n-gram in bytes; words of a passage.
SAMPLE, ORDER, PASSAGE = 3000, 7, 2
THRESHOLD = 0.7
#: Distinct words that a task counts before it hands them on; words of a generation (``Recent``) whose ratios it keeps.
CACHE_WORDS, KNOWN_WORDS = 400_000, 100_000
EDGES = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~¡¿«»„“”‘’…–—"


def words(text: str | None) -> list[str]:
    return [w for w in (x.strip(EDGES) for x in (text or "").lower().split()) if w]


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(F.encode(doc_id.cast("string"), "UTF-8")) % 3 == 1, F.lit(False))


#: Bits of a symbol in an n-gram code: words are read as UTF-8 bytes, so every character counts as itself.
_BITS = 8


def _codes(bag: list[str], order: int) -> tuple[np.ndarray, np.ndarray]:
    """The n-gram ending at each byte of each marked word, as a number, and its word's index.

    An n-gram has up to ``order`` bytes and none before the word's opening mark. Byte 0 is read as 1."""
    raw = [b"\x02" + w.encode("utf-8", "replace").replace(b"\0", b"\1") + b"\x03" for w in bag]
    symbols = np.frombuffer(b"".join(raw), np.uint8).astype(np.uint64)
    sizes = np.fromiter(map(len, raw), np.int64, len(bag))
    owner = np.repeat(np.arange(len(bag)), sizes)
    at = np.arange(len(symbols)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
    code = symbols.copy()
    for k in range(1, order):
        code[k:] |= np.where(at[k:] >= k, symbols[:-k] << np.uint64(_BITS * k), np.uint64(0))
    return code[at > 0], owner[at > 0]


def _length(code: np.ndarray, order: int) -> np.ndarray:
    return sum((code >> np.uint64(_BITS * k) > 0).astype(np.int64) for k in range(order))


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index of each wanted key in sorted keys, and whether it is there."""
    i = np.minimum(np.searchsorted(keys, wanted), max(0, len(keys) - 1))
    return i, keys[i] == wanted if len(keys) else np.zeros(len(wanted), bool)


def _by_context(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Contexts, each gram's context index, and each context's total and number of next bytes."""
    contexts, at = np.unique(grams >> np.uint64(_BITS), return_inverse=True)
    return contexts, at, np.bincount(at, counts, len(contexts)), np.bincount(at, counts > 0, len(contexts))


class RatioModel:
    """Log ratios of toxic to ordinary for each known n-gram, and for the weights of its backoff."""

    def __init__(self, grams: np.ndarray, ratio: np.ndarray, contexts: np.ndarray, weight: np.ndarray, order: int):
        self.grams, self.ratio, self.contexts, self.weight, self.order = grams, ratio, contexts, weight, order
        #: Log ratio and bytes, with the closing mark, of words met so far.
        self.known: dict[str, tuple[float, int]] = Recent(KNOWN_WORDS)

    @classmethod
    def fit(cls, bags: tuple[dict[str, float], dict[str, float]], order: int = ORDER) -> "RatioModel":
        """bags: counts of words in ordinary and in toxic texts."""
        vocabulary = sorted(bags[0].keys() | bags[1].keys())
        code, owner = _codes(vocabulary, order)
        grams, at = np.unique(code, return_inverse=True)
        return cls.of_counts(grams, [np.bincount(at, np.fromiter((bag.get(w, 0) for w in vocabulary), float, len(vocabulary))[owner], len(grams)) for bag in bags], order)

    @classmethod
    def of_counts(cls, grams: np.ndarray, counts: list[np.ndarray], order: int = ORDER) -> "RatioModel":
        """grams: distinct codes in rising order; counts: of each in ordinary and in toxic texts."""
        ones, twos = (sum(int((c == k).sum()) for c in counts) for k in (1, 2))
        discount = ones / (ones + 2 * twos) if ones and twos else 0.75
        # Shared backoff: a shorter n-gram counts its distinct left extensions in either class.
        length, level = _length(grams, order), {}
        longer = np.zeros(0, np.uint64)
        for n in range(order, 1, -1):
            every = np.unique(np.concatenate([grams[length == n], longer]))
            longer, extensions = np.unique(every & np.uint64((1 << _BITS * (n - 1)) - 1), return_counts=True)
            level[n - 1] = (longer, extensions.astype(float))
        keys, extensions = level[1]
        shared = {1: (keys, (extensions + 1) / (extensions.sum() + len(keys) + 1))}
        for n in range(2, order):
            keys, extensions = level[n]
            _, own, total, kinds = _by_context(keys, extensions)
            below, _ = _find(shared[n - 1][0], keys & np.uint64((1 << _BITS * (n - 1)) - 1))
            shared[n] = (keys, (np.maximum(extensions - discount, 0) + discount * kinds[own] * shared[n - 1][1][below]) / total[own])
        below = np.zeros(len(grams))
        for n in range(2, order + 1):
            here = length == n
            i, _ = _find(shared[n - 1][0], grams[here] & np.uint64((1 << _BITS * (n - 1)) - 1))
            below[here] = shared[n - 1][1][i]
        log_p, log_left = [], []
        for c in counts:
            contexts, own, total, kinds = _by_context(grams, c)
            left = np.where(total > 0, discount * kinds / np.maximum(total, 1), 1.0)
            log_left.append(np.log(left))
            log_p.append(np.log(np.maximum(c - discount, 0) / np.maximum(total[own], 1) + left[own] * below))
        return cls(grams, log_p[1] - log_p[0], contexts, log_left[1] - log_left[0], order)

    def learn(self, bag: Iterable[str]) -> None:
        """Scores words that are not known yet."""
        new = self.known.absent(bag)
        if not new:
            return
        code, owner = _codes(new, self.order)
        i, there = _find(self.grams, code)
        j, near = _find(self.contexts, code >> np.uint64(_BITS))
        step = np.where(there, self.ratio[i], np.where(near, self.weight[j], 0.0))
        ratios = np.bincount(owner, step, len(new)).tolist()
        sizes = np.bincount(owner, minlength=len(new)).tolist()
        self.known.update(zip(new, zip(ratios, sizes, strict=True), strict=True))

    def features(self, text: str | None) -> tuple[float, float, float]:
        """Difference of log-likelihoods a byte: that of the most toxic passage, of the most toxic one
        that does not overlap it (itself if there is none), and of the whole text."""
        every = words(text)
        if not every:
            return 0.0, 0.0, 0.0
        self.known.age()
        self.learn(set(every))
        known = self.known
        sums = np.zeros((len(every) + 1, 2))
        np.cumsum(np.array([known[w] for w in every]), axis=0, out=sums[1:])
        k = min(PASSAGE, len(every))
        runs = sums[k:] - sums[:-k]
        rates = runs[:, 0] / runs[:, 1]
        first = int(rates.argmax())
        apart = [part.max() for part in (rates[: max(0, first - k + 1)], rates[first + k :]) if len(part)]
        return float(rates[first]), float(max(apart, default=rates[first])), float(sums[-1, 0] / sums[-1, 1])


def _inputs(f: tuple[float, float, float]) -> list[float]:
    """Passages saturate: one far beyond doubt counts little more than one near it."""
    return [1.0, math.tanh(f[0] / 2), math.tanh(f[1] / 2), math.tanh(f[2])]


def logistic(rows: np.ndarray, labels: np.ndarray, ridge: float = 1e-2) -> np.ndarray:
    """Newton's method; few columns."""
    w = np.zeros(rows.shape[1])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(rows @ w, -30, 30)))
        step = np.linalg.solve((rows * (p * (1 - p))[:, None]).T @ rows + ridge * np.eye(len(w)), rows.T @ (labels - p) - ridge * w)
        w += step
        if abs(step).max() < 1e-8:
            break
    return w


class Scorer:
    """A fitted model with its curve."""

    def __init__(self, model: RatioModel | None, curve: np.ndarray | None):
        self.model, self.curve = model, None if curve is None else [float(x) for x in curve]

    def score(self, text: str | None) -> float:
        if self.model is None:
            return 0.0
        z = sum(a * b for a, b in zip(self.curve, _inputs(self.model.features(text)), strict=True))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, z))))


def _labelled(labels: DataFrame) -> DataFrame:
    """(doc_id, __y, __h, __half) for each labelled doc_id that is not held out."""
    one = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.max("toxic").alias("__y"))
    one = one.withColumns({"__h": F.xxhash64("doc_id"), "__y": (F.col("__y") > 0).cast("int")})
    return one.withColumn("__half", F.pmod("__h", F.lit(2)).cast("int"))


def _sample(labelled: DataFrame, size: int) -> DataFrame:
    parts = [least_hashes(labelled.where(F.col("__y") == y), "__h", size) for y in (0, 1)]
    return parts[0].union(parts[1]).select("doc_id", "__y", "__half")


def _gram_counts(rows: DataFrame, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct n-grams of rows (text, __y, __half) in rising order, and counts by half, class, n-gram."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bags: dict[tuple[int, int], Counter] = defaultdict(Counter)

        def flush() -> Iterator[pa.RecordBatch]:
            for (y, half), bag in bags.items():
                kind = pa.array(np.full(len(bag), 2 * y + half, np.int32))
                yield pa.RecordBatch.from_arrays([pa.array(bag.keys(), pa.string()), kind, pa.array(bag.values(), pa.int64())], names=["w", "kind", "n"])
            bags.clear()

        for batch in slices(batches):
            for text, y, half in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                bags[y, half].update(words(text))
            if sum(map(len, bags.values())) > CACHE_WORDS:
                yield from flush()
        yield from flush()

    def cut(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ws, kinds, n = batch.column(0).to_pylist(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
            code, owner = _codes(ws, order)
            keys, at = np.unique((code.astype(np.int64) << 2) | kinds[owner], return_inverse=True)
            sums = np.zeros(len(keys), np.int64)
            np.add.at(sums, at, n[owner])
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array(sums)], names=["key", "n"])

    bags = rows.mapInArrow(count, "w string, kind int, n long").groupBy("w", "kind").agg(F.sum("n").alias("n"))
    # One number for an n-gram and its kind.
    found = bags.mapInArrow(cut, "key long, n long").groupBy("key").agg(F.sum("n").alias("n")).toArrow()
    keys, n = (c.to_numpy() for c in found.columns)
    grams, at = np.unique((keys >> 2).astype(np.uint64), return_inverse=True)
    counts = np.zeros((2, 2, len(grams)))
    counts[keys & 1, (keys >> 1) & 1, at] = n
    return grams, counts


def fit(docs: DataFrame, labels: DataFrame, *, size: int = SAMPLE, order: int = ORDER) -> Scorer:
    """Counts all labelled rows, and fits the curve to at most ``size`` of each class."""
    spark, labelled = docs.sparkSession, _labelled(labels)
    # At most 2 * size rows of two integers, so the driver may hold and send them.
    chosen = {r["doc_id"]: (r["__y"], r["__half"]) for r in _sample(labelled, size).collect()}
    if len({y for y, _ in chosen.values()}) < 2:
        return Scorer(None, None)
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("__y", T.IntegerType()), T.StructField("__half", T.IntegerType())])
    picked = F.broadcast(spark.createDataFrame([(int(k), *v) for k, v in chosen.items()], schema))
    rows = docs.select("doc_id", "text").join(picked, "doc_id").select("text", "__y", "__half")
    # By merging at every size: labels grow with the corpus, so they are no table to broadcast.
    every = docs.select("doc_id", "text").join(labelled.select("doc_id", "__y", "__half").hint("merge"), "doc_id").select("text", "__y", "__half")
    grams, counts = _gram_counts(every, order)
    if not len(grams):
        return Scorer(None, None)
    both = counts.sum(axis=0)

    def model(own: np.ndarray) -> RatioModel:
        met = own.any(axis=0)
        return RatioModel.of_counts(grams[met], [c[met] for c in own], order)

    split = counts.any(axis=2).all()
    # Each half is judged by the model of the other, as unseen texts will be.
    halves = spark.sparkContext.broadcast([model(counts[1 - k] if split else both) for k in range(2)])

    def judge(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            found = [(y, *_inputs(halves.value[half].features(text))) for text, y, half in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            cols = list(zip(*found, strict=True)) if found else [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.float64()) for c in cols], names=list("yabcd"))

    table_ = rows.mapInArrow(judge, ", ".join(f"{k} double" for k in "yabcd")).toArrow()
    halves.unpersist()
    data = np.column_stack([c.to_numpy() for c in table_.columns]) if table_.num_rows else np.zeros((0, 5))
    if len(set(data[:, 0])) < 2:
        return Scorer(None, None)
    return Scorer(model(both), logistic(data[:, 1:], data[:, 0]))


def scored(docs: DataFrame, scorer: Scorer, *, column: str = "score") -> DataFrame:
    """``docs`` with a score column."""
    sent = docs.sparkSession.sparkContext.broadcast(scorer)
    at = docs.columns.index("text")
    out = T.StructType([*docs.schema.fields, T.StructField(column, T.DoubleType())])

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = pa.array([sent.value.score(t) for part in slices([batch]) for t in part.column(at).to_pylist()], pa.float64())
            yield pa.RecordBatch.from_arrays([*batch.columns, scores], names=[*batch.schema.names, column])

    return docs.mapInArrow(add, out)


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    out = scored(docs, fit(docs, table(spark, sf_dir, "labels")))
    return out.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
