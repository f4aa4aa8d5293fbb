"""Phrase collocation mining by pivots: each phrase is counted in the partition of its rarest word.

Method. Words are numbered from the most frequent on, so that of two words the one with the higher number
is the rarer. Around every word, its text is rewritten for it as the pivot: a neighbour that is rarer, or too
rare for any phrase, is a blank, and nothing is kept beyond a blank. What is left is a fragment of at most
five words; equal fragments of a chunk are one with a count. Fragments are routed to their pivot, whose
task counts the phrases of two and three words that hold it and emits no others, as those that hold a rarer
word were rewritten away. A phrase with its rarest word twice belongs to the first: to the left of the pivot
the pivot itself is a blank.

Plan. Documents are dealt by a hash into chunks of about ``CHUNK_BYTES``; texts are shuffled once. A chunk
becomes one row a language: its distinct words with counts, and its tokens as compressed numbers. Exploded
words are summed over the corpus by the JVM; the frequent ones get their numbers from a range-sorted table;
a plain join, which adaptive execution may split, tells them to the chunks. A word met more than ``LOAD``
times is a hot pivot: its fragments are dealt to several partitions by chunk, whose counts are added up
after. The others are final where they are counted, and only frequent phrases leave. Scores are decimals
of 38 digits, exact. The best of a language are chosen in rounds over fewer and fewer parts, so that no
task sees more of a language than the best of two parts.

Edge cases. A null text is empty; a null lang is ``und``, as is a lang of that name. Rows that repeat a
doc_id count each. Words are compared whole, as bytes; no hash stands for one. An empty table gives an empty
result. Other columns are not read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.common import Scratch, table

#: Least count of a phrase, most phrases of a language; percent of a phrase's count that make a longer one cover it.
LEAST, TOP, COVER = 10, 2000, 50
#: Mean bytes of text in a chunk; occurrences of a pivot that one partition takes; bytes of fragments counted at once.
CHUNK_BYTES, LOAD, BUFFER = 6_000_000, 500_000, 8_000_000
#: Parts of a language's phrases in each round of choosing; each takes the best ``TOP`` of its parts.
ROUNDS = (64, 32, 16, 8, 4, 2, 1)
#: Characters that end a piece, and what stands for them: a byte that UTF-8 does not have.
_ENDS, _END = b".,;:!?\n\x0b\x0c\r", b"\xff"
_TABLE = bytes.maketrans(_ENDS, _END * len(_ENDS))


def tokens(texts: Iterable[str | None]) -> list[bytes]:
    """Lower-cased words in order; ``_END`` between pieces and texts."""
    data = b"\n".join((t or "").encode("utf-8", "replace") for t in texts).lower().translate(_TABLE)
    return data.replace(_END, b" \xff ").split()


def _encoded(key: tuple, rows: pa.Table) -> pa.Table:
    """A chunk's texts as one row for each language."""
    chunk, langs, texts = key[0].as_py(), rows.column("lang").to_pylist(), rows.column("text")
    by_lang: dict[str, list[int]] = {}
    for i, lang in enumerate(langs):
        by_lang.setdefault(lang, []).append(i)
    out = []
    for lang, at in sorted(by_lang.items()):
        found = tokens(texts.take(pa.array(at)).to_pylist())
        words = sorted(set(found) - {_END})
        # Number 0 ends a piece.
        number = {_END: 0} | {w: i + 1 for i, w in enumerate(words)}
        ids = np.fromiter(map(number.__getitem__, found), np.int32, len(found))
        counts = np.bincount(ids, minlength=len(words) + 1)[1:]
        out.append((chunk, lang, zlib.compress(ids.tobytes(), 1), [w.decode() for w in words], counts.tolist()))
    names = ["chunk", "lang", "ids", "words", "counts"]
    types = [pa.int32(), pa.string(), pa.binary(), pa.list_(pa.string()), pa.list_(pa.int64())]
    return pa.table([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 5, types, strict=True)], names=names)


def _grouped(columns: list[np.ndarray], weights: np.ndarray | None = None) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct rows of integer columns in order of the first, then the next; and how many, or their weight."""
    if not len(columns[0]):
        return columns, np.zeros(0, np.int64)
    order = np.lexsort(columns[::-1])
    columns = [c[order] for c in columns]
    new = np.zeros(len(order), bool)
    new[0] = True
    for c in columns:
        new[1:] |= c[1:] != c[:-1]
    starts = np.flatnonzero(new)
    sums = np.add.reduceat(weights[order], starts) if weights is not None else np.diff(np.append(starts, len(order)))
    return [c[starts] for c in columns], sums


def fragments(t: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct fragments (pivot, second and first to the left, first and second to the right) of a text
    of word numbers, with counts. Numbers rise with rarity from 1; 0 is a word too rare, or an end."""
    n = len(t)
    if n < 2:
        return [np.zeros(0, t.dtype)] * 5, np.zeros(0, np.int64)
    pad = np.concatenate([np.zeros(2, t.dtype), t, np.zeros(2, t.dtype)])
    l2, l1, r1, r2 = (pad[k : k + n] for k in (0, 1, 3, 4))
    l1 = np.where(l1 < t, l1, 0)
    l2 = np.where((l1 > 0) & (l2 < t), l2, 0)
    r1 = np.where(r1 <= t, r1, 0)
    r2 = np.where((r1 > 0) & (r2 <= t), r2, 0)
    some = np.flatnonzero((t > 0) & ((l1 > 0) | (r1 > 0)))
    p, l2, l1, r1, r2 = (c[some] for c in (t, l2, l1, r1, r2))
    # Numbers of this text alone are small: three of them, then two, are one key.
    own = np.unique(np.append(t, 0))
    if len(own) >= 1 << 21:
        return _grouped([p, l2, l1, r1, r2])
    q, m2, m1, s1, s2 = (np.searchsorted(own, c).astype(np.int64) for c in (p, l2, l1, r1, r2))
    (high, low), counts = _grouped([q << 42 | m1 << 21 | s1, m2 << 21 | s2])
    low21 = (1 << 21) - 1
    return [own[x] for x in (high >> 42, low >> 21, (high >> 21) & low21, high & low21, low & low21)], counts


def phrases_of(p: np.ndarray, l2: np.ndarray, l1: np.ndarray, r1: np.ndarray, r2: np.ndarray, n: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
    """Distinct phrases (three numbers, the last 0 for two words) that hold their fragment's pivot, with counts."""
    none = np.zeros_like(p)
    kinds = [(l1 > 0, (l1, p, none)), (r1 > 0, (p, r1, none)), (l2 > 0, (l2, l1, p)), ((l1 > 0) & (r1 > 0), (l1, p, r1)), (r2 > 0, (p, r1, r2))]
    columns = [np.concatenate([words[k][there] for there, words in kinds]) for k in range(3)]
    return _grouped(columns, np.concatenate([n[there] for there, _ in kinds]))


_FRAGMENTS = "pivot long, salt int, hot boolean, blob binary"


def _rewrite(kind: str):
    def rewrite(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows (pivot, salt, hot, blob) of a chunk's fragments; a blob has five numbers for each."""
        for batch in batches:
            for chunk, raw, known in zip(batch.column("chunk").to_pylist(), batch.column("ids").to_pylist(), batch.column("known"), strict=True):
                ids = np.frombuffer(zlib.decompress(raw), np.int32)
                at, number, f = (known.values.field(k).to_numpy() for k in range(3))
                to = np.zeros(int(max(ids.max(initial=0), at.max(initial=0) + 1)) + 1, np.int64)
                to[at + 1] = number
                (p, *around), n = fragments(to[ids])
                if not len(p):
                    continue
                rows = np.column_stack([*around, n]).astype(kind)
                starts = np.flatnonzero(np.diff(p, prepend=-1))
                order = np.argsort(number)
                parts = -(-f[order][np.searchsorted(number[order], p[starts])] // LOAD)
                offsets = (np.append(starts, len(p)) * rows.dtype.itemsize * 5).astype(np.int32)
                blob = pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(rows.tobytes())])
                yield pa.RecordBatch.from_arrays([pa.array(p[starts]), pa.array((chunk % parts).astype(np.int32)), pa.array(parts > 1), blob], names=["pivot", "salt", "hot", "blob"])

    return rewrite


def _mined(kind: str, least: int):
    def mine(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts of phrases; rows come in order of pivot, so a pivot that is not hot is counted whole."""
        held: list[tuple[int, bool, bytes]] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            for hot in (False, True):
                rows = [(p, b) for p, h, b in held if h == hot]
                if not rows:
                    continue
                data = np.frombuffer(b"".join(b for _, b in rows), kind).reshape(-1, 5).astype(np.int64)
                sizes = [len(b) // (5 * np.dtype(kind).itemsize) for _, b in rows]
                pivots = np.repeat(np.array([p for p, _ in rows], np.int64), sizes)
                words, n = phrases_of(pivots, *(data[:, k] for k in range(5)))
                if not hot:
                    some = n >= least
                    words, n = [w[some] for w in words], n[some]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in (*words, n)], names=["w1", "w2", "w3", "n"])

        last = None
        for batch in batches:
            for p, hot, blob in zip(*(batch.column(c).to_pylist() for c in ("pivot", "hot", "blob")), strict=True):
                if size > BUFFER and (p != last or hot):
                    yield from flush()
                    held, size = [], 0
                held.append((p, hot, blob))
                size, last = size + len(blob), p
        yield from flush()

    return mine


def _numbered(frequent: DataFrame, scratch: Scratch) -> DataFrame:
    """Adds ``number``, from 1, by falling count: sorted by ranges, written, and each range counted from
    the end of the one before."""
    order = [F.col("f").desc(), F.col("lang"), F.col("word")]
    place = F.monotonically_increasing_id()
    rows = frequent.repartitionByRange(*order).sortWithinPartitions(*order).select("*", F.spark_partition_id().alias("part"), place.bitwiseAND(F.lit((1 << 33) - 1)).alias("row"))
    rows = scratch.write(rows)
    # One row a range: a number that the session sets, not the corpus.
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("part").agg(F.count(F.lit(1)).alias("size")).select("part", F.coalesce(F.sum("size").over(before), F.lit(0)).alias("start"))
    return scratch.write(rows.join(starts, "part").select("lang", "word", "f", (F.col("start") + F.col("row") + 1).alias("number")))


def _score(a: str, l: str, r: str) -> Column:  # noqa: E741
    """floor(1000000 * a * a / (l * r)) of three columns, without rounding on the way."""
    wide = "cast({} as decimal(19,0))".format
    return F.expr(f"({wide(a)} * {wide(a)} * cast(1000000 as decimal(7,0))) div ({wide(l)} * {wide(r)})")


def counted(docs: DataFrame, *, least: int = LEAST) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Frequent words (lang, word, f, number), phrases (w1, w2, w3, n) of word numbers, w3 0 for two
    words, and the number of words by lang (lang, n)."""
    spark, scratch = docs.sparkSession, Scratch(docs.sparkSession, "phrases")
    rows = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), "text", F.xxhash64("doc_id", "text").alias("h"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    chunks = max(1, -(-size // CHUNK_BYTES))
    rows = rows.select("lang", "text", F.pmod("h", F.lit(chunks)).cast("int").alias("chunk"))
    enc = scratch.write(rows.groupBy("chunk").applyInArrow(_encoded, "chunk int, lang string, ids binary, words array<string>, counts array<long>"))
    totals = enc.select("lang", F.aggregate("counts", F.lit(0).cast("long"), lambda x, y: x + y).alias("n")).groupBy("lang").agg(F.sum("n").alias("n"))
    words = enc.select("lang", F.explode(F.arrays_zip("words", "counts")).alias("x")).select("lang", F.col("x.words").alias("word"), F.col("x.counts").alias("n"))
    frequent = words.groupBy("lang", "word").agg(F.sum("n").alias("f")).where(F.col("f") >= least)
    frequent = _numbered(frequent, scratch)
    told = enc.select("chunk", "lang", F.posexplode("words").alias("at", "word")).join(frequent, ["lang", "word"])
    known = told.groupBy("chunk", "lang").agg(F.collect_list(F.struct("at", "number", "f")).alias("known"))
    met = enc.select("chunk", "lang", "ids").join(known, ["chunk", "lang"]).select("chunk", "ids", "known")
    # Numbers as narrow as they can be; a chunk's counts are smaller than its bytes.
    kind = "<i8" if (frequent.agg(F.max("number")).first()[0] or 0) >= 1 << 31 else "<i4"
    routed = met.mapInArrow(_rewrite(kind), _FRAGMENTS).repartition("pivot", "salt").sortWithinPartitions("pivot", "salt")
    mined = routed.mapInArrow(_mined(kind, least), "w1 long, w2 long, w3 long, n long")
    found = scratch.write(mined.groupBy("w1", "w2", "w3").agg(F.sum("n").alias("n")).where(F.col("n") >= least))
    return frequent, found, totals


def collocations(docs: DataFrame, *, least: int = LEAST, top: int = TOP) -> DataFrame:
    """(lang, rank, phrase, a, l, r, n, score): the best ``top`` phrases of each language.

    A phrase of count a is cut in two parts of counts l and r where its score is lowest; a phrase of
    two words that one of three words covers is left out."""
    words, found, totals = counted(docs, least=least)
    two = found.where("w3 = 0").select("w1", "w2", F.col("n").alias("a"))
    three = found.where("w3 > 0").withColumnRenamed("n", "a")

    def word(k: int) -> DataFrame:
        return words.select(F.col("number").alias(f"w{k}"), F.col("word").alias(f"t{k}"), F.col("f").alias(f"f{k}"), *([F.col("lang")] if k == 1 else []))

    inside = three.select("w1", "w2", "a").union(three.select(F.col("w2").alias("w1"), F.col("w3").alias("w2"), "a"))
    longest = inside.groupBy("w1", "w2").agg(F.max("a").alias("longer"))
    two_left = two.join(longest, ["w1", "w2"], "left").where(F.col("longer").isNull() | (100 * F.col("longer") < COVER * F.col("a")))
    pairs = two_left.join(word(1), "w1").join(word(2), "w2")
    pairs = pairs.select("lang", F.concat_ws(" ", "t1", "t2").alias("phrase"), "a", F.col("f1").alias("l"), F.col("f2").alias("r")).withColumn("score", _score("a", "l", "r"))
    cut = three.join(two.select("w1", "w2", F.col("a").alias("f12")), ["w1", "w2"]).join(two.select(F.col("w1").alias("w2"), F.col("w2").alias("w3"), F.col("a").alias("f23")), ["w2", "w3"])
    cut = cut.join(word(1), "w1").join(word(2).drop("f2"), "w2").join(word(3), "w3").withColumns({"s1": _score("a", "f1", "f23"), "s2": _score("a", "f12", "f3")})
    first = F.col("s1") <= F.col("s2")
    triples = cut.select("lang", F.concat_ws(" ", "t1", "t2", "t3").alias("phrase"), "a", F.when(first, F.col("f1")).otherwise(F.col("f12")).alias("l"), F.when(first, F.col("f23")).otherwise(F.col("f3")).alias("r"), F.least("s1", "s2").alias("score"))
    best = pairs.unionByName(triples).withColumn("deal", F.xxhash64("phrase"))
    for parts in ROUNDS:
        # A window with a limit on its rank keeps the best of each task before anything is shuffled.
        rank = F.row_number().over(Window.partitionBy("lang", F.pmod("deal", F.lit(parts))).orderBy(F.desc("score"), F.desc("a"), "phrase"))
        best = best.withColumn("rank", rank.cast("long")).where(F.col("rank") <= top)
    return best.join(totals, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))


OP12_SQL = f"""
WITH p AS (
  SELECT lang, row_number() OVER () AS p, piece FROM (
    SELECT coalesce(lang, 'und') AS lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents)
), w AS (
  SELECT lang, p, unnest(ws) AS w, generate_subscripts(ws, 1) AS i FROM (SELECT lang, p, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p)
), g AS (SELECT lang, w AS a1, lead(w) OVER (PARTITION BY p ORDER BY i) AS a2, lead(w, 2) OVER (PARTITION BY p ORDER BY i) AS a3 FROM w),
totals AS (SELECT lang, count(*) AS n FROM w GROUP BY lang),
one AS (SELECT lang, a1, count(*) AS f FROM g GROUP BY lang, a1),
two AS (SELECT lang, a1, a2, count(*) AS a FROM g WHERE a2 IS NOT NULL GROUP BY lang, a1, a2 HAVING count(*) >= {LEAST}),
three AS (SELECT lang, a1, a2, a3, count(*) AS a FROM g WHERE a3 IS NOT NULL GROUP BY lang, a1, a2, a3 HAVING count(*) >= {LEAST}),
longest AS (
  SELECT lang, a1, a2, max(a) AS longer FROM (SELECT lang, a1, a2, a FROM three UNION ALL SELECT lang, a2, a3, a FROM three) AS inside GROUP BY lang, a1, a2
), pairs AS (
  SELECT two.lang, two.a1 || ' ' || two.a2 AS phrase, two.a, x.f AS l, y.f AS r, (two.a::HUGEINT * two.a * 1000000) // (x.f::HUGEINT * y.f) AS score
  FROM two JOIN one AS x ON x.lang = two.lang AND x.a1 = two.a1 JOIN one AS y ON y.lang = two.lang AND y.a1 = two.a2
  LEFT JOIN longest AS g ON g.lang = two.lang AND g.a1 = two.a1 AND g.a2 = two.a2
  WHERE g.longer IS NULL OR 100 * g.longer < {COVER} * two.a
), cuts AS (
  SELECT three.lang, three.a1 || ' ' || three.a2 || ' ' || three.a3 AS phrase, three.a, x.f AS f1, z.f AS f3, b.a AS f12, c.a AS f23,
    (three.a::HUGEINT * three.a * 1000000) // (x.f::HUGEINT * c.a) AS s1, (three.a::HUGEINT * three.a * 1000000) // (b.a::HUGEINT * z.f) AS s2
  FROM three JOIN one AS x ON x.lang = three.lang AND x.a1 = three.a1 JOIN one AS z ON z.lang = three.lang AND z.a1 = three.a3
  JOIN two AS b ON b.lang = three.lang AND b.a1 = three.a1 AND b.a2 = three.a2 JOIN two AS c ON c.lang = three.lang AND c.a1 = three.a2 AND c.a2 = three.a3
), every AS (
  SELECT lang, phrase, a, l, r, score FROM pairs
  UNION ALL
  SELECT lang, phrase, a, CASE WHEN s1 <= s2 THEN f1 ELSE f12 END, CASE WHEN s1 <= s2 THEN f23 ELSE f3 END, CASE WHEN s1 <= s2 THEN s1 ELSE s2 END FROM cuts
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM every)
SELECT ranked.lang, rank, phrase, a, l, r, totals.n, score::BIGINT AS score FROM ranked JOIN totals ON ranked.lang = totals.lang WHERE rank <= {TOP}
"""
