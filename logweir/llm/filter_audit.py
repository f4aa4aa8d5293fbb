"""Filter interaction audit: which documents each filter removes, in every order of the filters.

Method. Five filters give a document a mask of five bits; all that an order of filters does to a set
of documents follows from how many of them have each mask. Four filters look at one text. The fifth,
"an equal text has a smaller doc_id", is a fingerprint-routed RDD: a task keeps chains by xxhash of
the text, each link with the full text and the least id it has met, so that texts that collide stay
apart. A row that is not the least is settled where it lies; what is left, one copy of each text a task, is
routed by its fingerprint to one partition, whose chains find the least of all and emit the others.
Labels meet the ids, without texts, in a join; ``combineByKey`` then merges one vector of counts by mask
for each part.

Scale. A text leaves a task once, however often it is copied, so a group of copies with a third of all
rows sends one text and one id a task. A task's chains are sent on when they hold ``CHAIN_BYTES``; the
number of partitions follows the bytes of the table, so that the chains of one hold about as much.
Results are 600 rows a part, made in the tasks that own the parts.

Edge cases. A null text is empty. A null or empty lang is the part "". Rows that repeat a doc_id
count each; equal texts under one doc_id are no copies of each other. A null doc_id is smaller than
none, has no smaller one, and has no labels. A doc_id labelled twice has a label if any of its rows
says so; null labels say nothing. An empty table gives an empty result. Other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import permutations

import numpy as np
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import table

FILTERS = "ABCDE"
#: Bounds of the filters: least words, least distinct words and most capitals in percent.
LEAST_WORDS, LEAST_DISTINCT, MOST_CAPITALS = 200, 50, 3
_CAPITALS, _MARKS = b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"#$%&*|"
_COPY = 1 << FILTERS.index("E")
#: Bytes of text that the chains of one task hold, about.
CHAIN_BYTES = 32_000_000

RESULT = "part string, filter_order string, step int, kept long, removed long, redundant long, unique_fails long, good_lost long, toxic_lost long, shapley long"


def text_mask(text: str, data: bytes) -> int:
    """Bits of the filters A to D that a text fails; ``data`` is its UTF-8."""
    words = data.split()
    few = len(words) < LEAST_WORDS
    dull = 100 * len(set(words)) < LEAST_DISTINCT * len(words)
    loud = 100 * (len(data) - len(data.translate(None, _CAPITALS))) > MOST_CAPITALS * len(text)
    marked = len(data.translate(None, _MARKS)) < len(data)
    return few | dull << 1 | loud << 2 | marked << 3


class Chains:
    """Texts by fingerprint, each with the least id met and the rows that have it.

    Rows are counted by (lang, mask). What ``add`` gives are rows now known not to be the least."""

    def __init__(self):
        self.links: dict[int, list[list]] = {}
        self.held = 0

    def add(self, print_: int, data: bytes, doc_id: int, rows: dict[tuple[str, int], int]) -> tuple[int, dict] | None:
        chain = self.links.setdefault(print_, [])
        for link in chain:
            if link[0] != data:
                continue
            if doc_id > link[1]:
                return doc_id, rows
            if doc_id == link[1]:
                for row, n in rows.items():
                    link[2][row] = link[2].get(row, 0) + n
                return None
            lost = link[1], link[2]
            link[1], link[2] = doc_id, dict(rows)
            return lost
        chain.append([data, doc_id, dict(rows)])
        self.held += len(data) + 200
        return None

    def drain(self) -> Iterator[tuple[int, bytes, int, dict]]:
        for print_, chain in self.links.items():
            for data, doc_id, rows in chain:
                yield print_, data, doc_id, rows
        self.links, self.held = {}, 0


def _settled(doc_id: int | None, rows: dict, copy: int) -> Iterator[tuple]:
    for (lang, mask), n in rows.items():
        yield doc_id, lang, mask | copy, n


def _route(docs: Iterable) -> Iterator[tuple]:
    """(fingerprint, text, least id, rows) of chains, and (id, settled row) of what is no least."""
    chains = Chains()
    for doc_id, lang, text in docs:
        text = text or ""
        data = text.encode("utf-8", "surrogatepass")
        rows = {(lang or "", text_mask(text, data)): 1}
        if doc_id is None:
            # Spread by what the row is: such rows meet nothing.
            yield from ((xxhash.xxh64_intdigest(data), row) for row in _settled(None, rows, 0))
            continue
        lost = chains.add(xxhash.xxh64_intdigest(data), data, doc_id, rows)
        if lost is not None:
            yield from ((lost[0], row) for row in _settled(*lost, _COPY))
        if chains.held > CHAIN_BYTES:
            yield from ((link[0], link) for link in chains.drain())
    yield from ((link[0], link) for link in chains.drain())


def _meet(routed: Iterable) -> Iterator[tuple]:
    chains = Chains()
    for key, value in routed:
        # A link has the text in second place, a settled row the part.
        if isinstance(value[1], str):
            yield value
            continue
        lost = chains.add(key, *value[1:])
        if lost is not None:
            yield from _settled(*lost, _COPY)
    for _, _, doc_id, rows in chains.drain():
        yield from _settled(doc_id, rows, 0)


def masks(docs: DataFrame) -> DataFrame:
    """(doc_id, part, mask, n): the filters that rows of ``docs`` fail, rows that agree counted together."""
    spark = docs.sparkSession
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(spark.sparkContext.defaultParallelism, -(-size // CHAIN_BYTES))
    rows = docs.select(F.col("doc_id").cast("long"), "lang", "text").rdd.mapPartitions(_route)
    met = rows.partitionBy(n, lambda key: key).mapPartitions(_meet)
    return spark.createDataFrame(met, "doc_id long, part string, mask int, n long", verifySchema=False)


#: A vector of counts: all documents by mask, then the good, then the toxic ones.
_MASKS = 1 << len(FILTERS)


def _add(vector: np.ndarray, row: tuple) -> np.ndarray:
    mask, n, good, toxic = row
    vector[0, mask] += n
    vector[1, mask] += n * good
    vector[2, mask] += n * toxic
    return vector


def effects(counts: np.ndarray) -> Iterator[tuple]:
    """(order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley) for
    counts by mask, of all, good and toxic documents."""
    every = np.arange(counts.shape[1])
    bit = {f: 1 << i for i, f in enumerate(FILTERS)}
    steps, shapley = [], dict.fromkeys(FILTERS, 0)
    for order in permutations(FILTERS):
        gone = 0
        for k, f in enumerate(order):
            fails, before = (every & bit[f]) > 0, (every & gone) > 0
            here = counts[:, fails & ~before].sum(axis=1)
            gone |= bit[f]
            kept = counts[0, (every & gone) == 0].sum()
            shapley[f] += int(here[0])
            steps.append(("".join(order), k + 1, f, int(kept), int(here[0]), int(counts[0, fails & before].sum()), int(counts[0, bit[f]]), int(here[1]), int(here[2])))
    for order, step, f, *rest in steps:
        yield (order, step, *rest, shapley[f])


def audit(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row for each part, order of the filters, and step."""
    spark = docs.sparkSession
    marks = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(
        F.coalesce(F.max((F.col("quality") == 1).cast("int")), F.lit(0)).alias("good"), F.coalesce(F.max((F.col("toxic") == 1).cast("int")), F.lit(0)).alias("toxic"))
    rows = masks(docs).join(marks, "doc_id", "left").select("part", "mask", "n", F.coalesce("good", F.lit(0)).alias("good"), F.coalesce("toxic", F.lit(0)).alias("toxic"))
    pairs = rows.rdd.map(lambda r: (r[0], (r[1], r[2], r[3], r[4])))
    vectors = pairs.combineByKey(lambda row: _add(np.zeros((3, _MASKS), np.int64), row), _add, lambda a, b: a + b)
    return spark.createDataFrame(vectors.flatMap(lambda kv: ((kv[0], *row) for row in effects(kv[1]))), RESULT, verifySchema=False)


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


OP11_SQL = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, coalesce(lang, '') AS part, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), least AS (SELECT t, min(doc_id) AS first FROM d GROUP BY t),
lab AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
m AS (
  SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
    CASE WHEN len(w) < {LEAST_WORDS} THEN 1 ELSE 0 END
    + CASE WHEN 100 * len(list_distinct(w)) < {LEAST_DISTINCT} * len(w) THEN 2 ELSE 0 END
    + CASE WHEN 100 * (length(d.t) - length(regexp_replace(d.t, '[A-Z]', '', 'g'))) > {MOST_CAPITALS} * length(d.t) THEN 4 ELSE 0 END
    + CASE WHEN regexp_matches(d.t, '[#$%&*|]') THEN 8 ELSE 0 END
    + CASE WHEN d.doc_id > least.first THEN 16 ELSE 0 END AS mask
  FROM d JOIN least ON d.t = least.t LEFT JOIN lab ON d.doc_id = lab.doc_id
), c AS (SELECT part, mask, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM m GROUP BY part, mask),
f AS (SELECT * FROM (VALUES ('A', 1), ('B', 2), ('C', 4), ('D', 8), ('E', 16)) AS v(name, bit)),
o(filter_order) AS (
  SELECT name FROM f
  UNION ALL
  SELECT filter_order || name FROM o, f WHERE length(filter_order) < 5 AND NOT contains(filter_order, name)
), s AS (
  SELECT filter_order, f.name, f.bit, strpos(filter_order, f.name) AS step,
    (SELECT coalesce(sum(g.bit), 0) FROM f AS g WHERE strpos(filter_order, g.name) < strpos(filter_order, f.name)) AS gone
  FROM o, f WHERE length(filter_order) = 5
), a AS (
  SELECT part, filter_order, name, step,
    sum(CASE WHEN (mask & (gone::INT | bit)) = 0 THEN n ELSE 0 END) AS kept,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & gone::INT) = 0 THEN n ELSE 0 END) AS removed,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & gone::INT) > 0 THEN n ELSE 0 END) AS redundant,
    sum(CASE WHEN mask = bit THEN n ELSE 0 END) AS unique_fails,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & gone::INT) = 0 THEN good ELSE 0 END) AS good_lost,
    sum(CASE WHEN (mask & bit) > 0 AND (mask & gone::INT) = 0 THEN toxic ELSE 0 END) AS toxic_lost
  FROM c, s GROUP BY part, filter_order, name, step
)
SELECT part, filter_order, step::INT AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails,
  good_lost::BIGINT AS good_lost, toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, name))::BIGINT AS shapley
FROM a
"""
