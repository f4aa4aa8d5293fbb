"""N-gram Jaccard join: pivots, triangle-inequality windows and recursive regions, exact.

Jaccard distance, 1 - J, is a metric; documents link at distance 0.25 or less.

1. Sets. Equal texts are read once. A document's set is its distinct shingle hashes (64 bits; within
   one pair a clash has odds below 1e-13). Corpus-wide counts of all shingles give each document the
   shingles it shares with any other; only those can add to an overlap. By the prefix rule a linked
   pair shares one of each document's rarest quarter of shingles, so a document whose rarest quarter
   is all its own is settled alone: almost all documents are. Rare-first order also keeps passages
   that many documents share out of the prefixes.
2. Regions. Pivots are data points: among documents that share a prefix shingle the smallest id is
   the pivot, and a document goes to the region of each pivot it meets so. Any linked pair shares a
   region. Distances to the pivot are computed once a (pivot, document).
3. Balls. Documents within 0.25 of a pivot are linked with it: one component, with no pair between
   them looked at. A region whose members are all in the ball is finished, as groups of thousands
   of copies are.
4. Windows. Else, by the triangle inequality, a member can only link with members whose distance to
   the pivot differs by at most 0.25: ball members too near the pivot for every outsider leave, and
   the rest is cut into strips of bounded size by distance; a strip is replicated to the strips
   within the window, so each task joins two strips of bounded size.
5. Inside a task the join recurses: a new pivot, its ball, the window around it; small rests are
   compared pair by pair, skipping pairs that are in one component already. Only links that join two
   components are emitted, never the pairs of a group.

Components come from the links by distributed star rounds.

Edge cases. Null, empty and blank texts have an empty set and link with nothing. Texts of fewer
words than the width have one shingle. Rows that repeat a doc_id are one node with the links of all
its texts; each row is returned. A null doc_id links with nothing and has a null component. Extra columns are not read by
the join. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.chunks import Chunks, Docs
from logweir.llm.common import Scratch, sheltered, table, wide_hash
from logweir.llm.components import components
from logweir.llm.text_hash import shingle_sets

WIDTH, PERCENT = 5, 75
#: Members of a strip; a task joins at most two strips.
STRIP = 1000
#: Members below which a region is compared pair by pair.
SMALL = 48
_SETS = "h1 long, h2 long, id long, n long, prefix long, shared binary"


def linked(inter: int, a: int, b: int, percent: int) -> bool:
    return 100 * inter >= percent * (a + b - inter)


def _sets(docs: Docs, width: int, percent: int) -> pa.Table:
    sets = shingle_sets(docs.texts, width)
    every = np.unique(np.concatenate(sets)) if sets else np.zeros(0, np.uint64)
    codes = docs.codes(1)
    n, prefix, shared = [], [], []
    for own in sets:
        code = codes[np.searchsorted(every, own)]
        reach = len(own) - -(-percent * len(own) // 100) + 1
        alone = int((code == 0).sum())
        n.append(len(own))
        if len(own) and alone < reach:
            rare = np.lexsort((own, code))[alone:]
            prefix.append(reach - alone)
            shared.append(own[rare].tobytes())
        else:
            prefix.append(0)
            shared.append(None)
    return pa.table({"h1": pa.array(docs.h1, pa.int64()), "h2": pa.array(docs.h2, pa.int64()), "id": pa.array(docs.ids, pa.int64()), "n": pa.array(n, pa.int64()), "prefix": pa.array(prefix, pa.int64()), "shared": pa.array(shared, pa.binary())})


def _prefixes(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        ids, counts, blobs = (c.to_pylist() for c in batch.columns)
        tokens = np.frombuffer(b"".join(b[: 8 * k] for b, k in zip(blobs, counts, strict=True)), np.int64)
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.array(ids, np.int64), counts)), pa.array(tokens)], names=["id", "token"])


def _distances(percent: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            pivot, ids, n, blob, pivot_n, pivot_blob = (c.to_pylist() for c in batch.columns)
            kept: dict[int, np.ndarray] = {}
            distance, inside = [], []
            for p, a, x, b, y in zip(pivot, n, blob, pivot_n, pivot_blob, strict=True):
                if p not in kept:
                    kept = {p: np.sort(np.frombuffer(y, np.uint64))}
                inter = _overlap(kept[p], np.frombuffer(x, np.uint64))
                distance.append(1 - inter / (a + b - inter))
                inside.append(linked(inter, a, b, percent))
            yield pa.RecordBatch.from_arrays([pa.array(pivot, pa.int64()), pa.array(ids, pa.int64()), pa.array(distance, pa.float64()), pa.array(inside, pa.bool_())], names=["pivot", "id", "d", "ball"])

    return run


def _overlap(sorted_set: np.ndarray, other: np.ndarray) -> int:
    if not len(sorted_set):
        return 0
    at = np.minimum(np.searchsorted(sorted_set, other), len(sorted_set) - 1)
    return int((sorted_set[at] == other).sum())


class _Forest:
    def __init__(self, n: int):
        self.up = list(range(n))

    def find(self, i: int) -> int:
        while self.up[i] != i:
            self.up[i] = self.up[self.up[i]]
            i = self.up[i]
        return i

    def join(self, i: int, j: int) -> bool:
        i, j = self.find(i), self.find(j)
        if i != j:
            self.up[max(i, j)] = min(i, j)
        return i != j


def join_region(sizes: list[int], shared: list[np.ndarray], known: list[tuple[int, int]], percent: int) -> list[tuple[int, int]]:
    """Links that, with ``known`` ones, give a region's components; recursive and exact."""
    forest, links = _Forest(len(sizes)), []
    for i, j in known:
        forest.join(i, j)
    ordered = [np.sort(s) for s in shared]
    far = 1 - percent / 100 + 1e-9

    def compare(i: int, js: list[int]) -> np.ndarray:
        """Distance of i to each j, and links of those near enough."""
        lengths = np.array([len(ordered[j]) for j in js])
        every = np.concatenate([ordered[j] for j in js])
        own = ordered[i]
        hit = own[np.minimum(np.searchsorted(own, every), len(own) - 1)] == every
        inter = np.add.reduceat(hit.astype(np.int64), np.cumsum(lengths) - lengths)
        union = sizes[i] + np.array([sizes[j] for j in js]) - inter
        for k in np.flatnonzero(100 * inter >= percent * union):
            if forest.join(i, js[k]):
                links.append((i, js[k]))
        return 1 - inter / union

    todo = [list(range(len(sizes)))]
    while todo:
        members = todo.pop()
        if len({forest.find(i) for i in members}) < 2:
            continue
        if len(members) <= SMALL:
            for k, i in enumerate(members):
                js = [j for j in members[k + 1 :] if forest.find(j) != forest.find(i) and 100 * min(sizes[i], sizes[j]) >= percent * max(sizes[i], sizes[j])]
                if js:
                    compare(i, js)
            continue
        # The pivot comes from the component with the fewest members, so that each round settles it or shrinks.
        roots = [forest.find(i) for i in members]
        count: dict[int, int] = {}
        for r in roots:
            count[r] = count.get(r, 0) + 1
        pivot = min(members, key=lambda i: (count[forest.find(i)], i))
        rest = [i for i in members if i != pivot]
        d = compare(pivot, rest)
        # Members at distance 2 * far and more from the pivot cannot link with its near ones: split there.
        near = [i for i, x in zip(rest, d, strict=True) if x <= 2 * far]
        if 2 * len(near) < len(rest):
            # Inner part: all that may link with a member within far of the pivot; the pivot itself is done.
            ball = [i for i, x in zip(rest, d, strict=True) if x <= far]
            todo.append([i for i in rest if i not in set(ball)])
            if ball:
                todo.append(near)
        else:
            todo.append(rest)
    return links


def _strips(percent: int, size: int):
    def run(rows):
        """Joins two strips of a region, or one with itself."""
        ids = rows.column("id").to_pylist()
        at = {}
        for k, i in enumerate(ids):
            at.setdefault(i, k)
        keep = list(at.values())
        rows = rows.take(keep)
        ids, sizes, ball = (rows.column(c).to_pylist() for c in ("id", "n", "ball"))
        shared = [np.frombuffer(b, np.uint64) for b in rows.column("shared").to_pylist()]
        inside = [k for k, b in enumerate(ball) if b]
        found = join_region(sizes, shared, [(inside[0], k) for k in inside[1:]], percent)
        return pa.table({"a": pa.array([ids[i] for i, _ in found], pa.int64()), "b": pa.array([ids[j] for _, j in found], pa.int64())})

    return run


def find_links(sets: DataFrame, scratch: Scratch, *, percent: int = PERCENT, strip: int = STRIP) -> DataFrame:
    """Links (a, b) whose components are those of all linked pairs of ``sets``."""
    # Sets meet under numbers of their own, since different texts may have one doc_id.
    numbered = sets.where("shared IS NOT NULL AND id IS NOT NULL").select(F.monotonically_increasing_id().alias("own"), "id", "n", "prefix", "shared")
    numbered = scratch.write(numbered)
    sharing = numbered.select(F.col("own").alias("id"), "n", "prefix", "shared")
    prefixes = scratch.write(sharing.select("id", "prefix", "shared").mapInArrow(_prefixes, "id long, token long"))
    # Aggregates are written out before they join what they were made from: a join need not keep
    # their partitioning then, and a shingle or pivot of very many documents can be split.
    blocks = prefixes.groupBy("token").agg(F.min("id").alias("pivot"), F.count(F.lit(1)).alias("k")).where("k > 1").select("token", "pivot")
    regions = prefixes.join(scratch.write(blocks), "token").where("id <> pivot").select("pivot", "id").distinct()
    mine = regions.join(sharing.select("id", "n", "shared"), "id")
    pivots = sharing.select(F.col("id").alias("pivot"), F.col("n").alias("pivot_n"), F.col("shared").alias("pivot_shared"))
    pairs = mine.join(pivots, "pivot").select("pivot", "id", "n", "shared", "pivot_n", "pivot_shared")
    measured = scratch.write(pairs.mapInArrow(_distances(percent), "pivot long, id long, d double, ball boolean"))
    links = measured.where("ball").select(F.col("pivot").alias("a"), F.col("id").alias("b"))
    far = 1 - percent / 100
    outside = measured.groupBy("pivot").agg(F.min(F.when(~F.col("ball"), F.col("d"))).alias("nearest"), F.count_if(~F.col("ball")).alias("outside"), F.count_if("ball").alias("inside"))
    # A lone outsider of an empty ball has nobody left to link with.
    open_ = outside.where("outside > 1 OR outside = 1 AND inside > 0").select("pivot", "nearest")
    open_ = scratch.write(open_)
    rest = measured.join(open_, "pivot").where(~F.col("ball") | (F.col("d") >= F.col("nearest") - far - 1e-9)).select("pivot", "id", "d", "ball")
    rest = scratch.write(rest)
    counts = rest.groupBy("pivot").agg(F.count(F.lit(1)).alias("m"), F.count_if(~F.col("ball")).alias("o"))
    counts = counts.where("m > 1 AND o > 0").select("pivot", F.ceil(F.col("m") / strip).cast("int").alias("strips"))
    counts = scratch.write(counts)
    # Strips: bands of distance as wide as the window, each split by hash where the region is large.
    small = counts.where("strips = 1").select("pivot")
    task = rest.join(small, "pivot").select("pivot", F.lit(0).alias("s"), F.lit(0).alias("t"), "id", "ball")
    large = rest.join(counts.where("strips > 1"), "pivot")
    own = F.pmod(F.xxhash64("id"), F.col("strips")).cast("int")
    band = F.least(F.floor(F.col("d") / far), F.lit(int(1 / far))).cast("int")
    large = large.withColumns({"cell": band * F.col("strips") + own, "band": band})
    # A cell meets its own band's cells and the next band's: what the window allows, and no more.
    others = F.sequence(F.col("band") * F.col("strips"), F.greatest(F.col("band") * F.col("strips"), (F.col("band") + 2) * F.col("strips") - 1))
    before = F.sequence(F.greatest(F.lit(0), (F.col("band") - 1) * F.col("strips")), (F.col("band") + 1) * F.col("strips") - 1)
    as_first = large.select("pivot", F.col("cell").alias("s"), F.explode(F.filter(others, lambda x: x >= F.col("cell"))).alias("t"), "id", "ball")
    as_second = large.select("pivot", F.explode(F.filter(before, lambda x: x < F.col("cell"))).alias("s"), F.col("cell").alias("t"), "id", "ball")
    task = task.unionByName(as_first).unionByName(as_second)
    loaded = task.join(sharing.select("id", "n", "shared"), "id")
    more = loaded.groupBy("pivot", "s", "t").applyInArrow(_strips(percent, strip), "a long, b long")
    named = links.union(more)
    for end in ("a", "b"):
        name = numbered.select(F.col("own").alias(end), F.col("id").alias("__id"))
        named = named.join(name, end).drop(end).withColumnRenamed("__id", end)
    return named.select("a", "b")


def near_duplicates(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """(doc_id, h1, h2, n_shingles, component_id) for each row of ``docs``; h1 and h2 hash its text."""
    scratch = Scratch(docs.sparkSession, "jaccard")
    chunks = Chunks(docs, scratch)

    def keys(part: Docs) -> np.ndarray:
        sets = shingle_sets(part.texts, width)
        return np.concatenate(sets) if sets else np.zeros(0, np.uint64)

    chunks.count_keys(1, keys)
    sets = scratch.write(chunks.each(lambda part: _sets(part, width, percent), _SETS))
    found = components(find_links(sets, scratch, percent=percent).union(_same_id(chunks)), scratch)
    group = sets.select("h1", "h2", "id", "n").join(found, sets["id"] == found["node"], "left")
    group = group.select("h1", "h2", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.coalesce("component", "id")).alias("component_id"))
    rows = chunks.hashed.drop("size").join(group, ["h1", "h2"])
    return rows.withColumn("component_id", F.when(F.col("doc_id").isNull(), F.lit(None)).otherwise(F.coalesce("component_id", "doc_id")))


def _same_id(chunks: Chunks) -> DataFrame:
    """Rows that repeat a doc_id with another text make that id one node with both texts' groups."""
    repeated = chunks.hashed.where("doc_id IS NOT NULL AND size > 0").groupBy("doc_id").agg(F.count(F.lit(1)).alias("k")).where("k > 1").select("doc_id")
    rows = chunks.hashed.where("size > 0").join(repeated, "doc_id").join(chunks.groups.select("h1", "h2", "id"), ["h1", "h2"])
    return rows.where("doc_id <> id").select(F.col("doc_id").alias("a"), F.col("id").alias("b"))


def keep_one(docs: DataFrame, *, width: int = WIDTH, percent: int = PERCENT) -> DataFrame:
    """One document of each group stays: that with the smallest doc_id, once. Rows without a doc_id stay."""
    columns = docs.columns
    docs, inner = sheltered(docs, "doc_id", "text")
    found = near_duplicates(docs.select("doc_id", "text"), width=width, percent=percent)
    first = found.where("doc_id = component_id").groupBy("doc_id").agg(F.min(F.struct("h1", "h2")).alias("__first")).withColumnRenamed("doc_id", "__id")
    h1, h2 = wide_hash(F.coalesce(F.col("text"), F.lit("")))
    rows = docs.withColumn("__text", F.struct(h1.alias("h1"), h2.alias("h2")))
    # One exchange by doc_id serves the join and the window.
    own = rows.where(F.col("doc_id").isNotNull()).join(first, rows["doc_id"] == first["__id"]).where(F.col("__text") == F.col("__first"))
    once = own.withColumn("__k", F.row_number().over(Window.partitionBy("doc_id").orderBy("__text"))).where("__k = 1")
    names = [F.col(inner[c]).alias(c) for c in columns]
    return once.select(*names).union(rows.where(F.col("doc_id").isNull()).select(*names))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select("doc_id", "n_shingles", "component_id")
