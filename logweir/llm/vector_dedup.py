"""Embedding near-dedup: an epsilon grid order join of unit vectors, within equal labels.

Cosine of at least t means a distance of unit vectors of at most epsilon = sqrt(2 - 2t). Vectors
are projected on leading principal directions, which never lengthens a distance, and sorted by
label and by their grid cells of side epsilon, first direction first. The sorted sequence is cut into
intervals of at most ``INTERVAL`` vectors with the box of their projections. Two intervals are joined
only if their boxes come within epsilon; the join recurses on halves, skips distant ones and compares
small ones by a matrix product in double precision, so no link is missed and none is false.

Interval pairs are found by an equi-join on label and first cell, then by boxes. Equal vectors are
one point with a weight, so a third of all rows may share a vector. A pair of intervals emits link
counts and links that join components, never its pairs; components come from distributed star rounds.

The directions are fitted to a sample of ``SAMPLE`` vectors with the least hashes; any directions
give the same result, only the skipping differs.

Edge cases. Null labels, null vectors, vectors of no length, and null or non-finite components link
with nothing: n_links 0, component their own. Vectors of unlike dimension never link. Rows that
repeat a vec_id are separate vectors with the same name. A null vec_id takes part in counts; its own
component is the group's, or null if alone. Extra columns are not read. An empty table gives an
empty result.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import Scratch, least_hashes, table
from logweir.llm.components import components

COSINE, INTERVAL, LEAF, SAMPLE, DIRECTIONS = 0.93, 1024, 128, 4096, 6


def usable(vector: Column) -> Column:
    """Has a direction: no null or non-finite component, not all nought."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return F.coalesce(good & F.exists(vector, lambda x: x != 0), F.lit(False))


def _unit(blob: bytes, d: int) -> np.ndarray:
    v = np.frombuffer(blob, np.float64).reshape(-1, d)
    v = v / np.abs(v).max(axis=1, keepdims=True)
    return v / np.sqrt((v * v).sum(axis=1, keepdims=True))


def directions(points: DataFrame, size: int, count: int) -> dict[int, np.ndarray]:
    """Leading principal directions of a bounded sample, for each dimension met in it."""
    rows = least_hashes(points.select("v", F.xxhash64("v").alias("__h")), "__h", size).select("v").collect()
    by: dict[int, list] = {}
    for (v,) in rows:
        by.setdefault(len(v), []).append(v)
    out = {}
    for d, vs in by.items():
        u = _unit(np.array(vs, np.float64).tobytes(), d)
        _, _, axes = np.linalg.svd(u - u.mean(axis=0), full_matrices=True)
        out[d] = axes[:count]
    return out


def _cells(axes: dict[int, np.ndarray], epsilon: float, count: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            vectors = batch.column(batch.schema.get_field_index("v")).to_pylist()
            cells = np.zeros((len(vectors), count), np.int64)
            for d in {len(v) for v in vectors}:
                at = [i for i, v in enumerate(vectors) if len(v) == d]
                u = _unit(np.array([vectors[i] for i in at], np.float64).tobytes(), d)
                z = u @ _axes(axes, d).T
                cells[at, : z.shape[1]] = np.floor(z / epsilon)
            extra = [pa.array(cells[:, k]) for k in range(count)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], names=[*batch.schema.names, *[f"c{k}" for k in range(count)]])

    return run


def _axes(axes: dict[int, np.ndarray], d: int) -> np.ndarray:
    return axes[d] if d in axes else np.eye(d)[: max((len(a) for a in axes.values()), default=1)]


_BLOCK = "block long, label long, d int, lo array<double>, hi array<double>, ids binary, weights binary, vectors binary, first long, last long"


def _intervals(axes: dict[int, np.ndarray], epsilon: float, size: int):
    """Cuts each sorted partition into intervals of one label and dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, key = TaskContext.get().partitionId() << 32, [], None

        def flush():
            nonlocal number, held
            label, d = key
            raw = np.array([v for _, _, v in held], np.float64)
            z = _unit(raw.tobytes(), d) @ _axes(axes, d).T
            first = np.floor(z[:, 0] / epsilon).astype(np.int64)
            row = [[number], [label], [d], [z.min(axis=0)], [z.max(axis=0)], [np.array([i for i, _, _ in held], np.int64).tobytes()], [np.array([w for _, w, _ in held], np.int64).tobytes()], [raw.tobytes()], [int(first.min())], [int(first.max())]]
            number, held = number + 1, []
            types = [pa.int64(), pa.int64(), pa.int32(), pa.list_(pa.float64()), pa.list_(pa.float64()), pa.binary(), pa.binary(), pa.binary(), pa.int64(), pa.int64()]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(row, types, strict=True)], names=[x.split()[0] for x in _BLOCK.split(", ")])

        for batch in batches:
            for group, label, weight, v in zip(*(batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("id", "label", "weight", "v")), strict=True):
                if held and (len(held) >= size or key != (label, len(v))):
                    yield flush()
                key = (label, len(v))
                held.append((group, weight, v))
        if held:
            yield flush()

    return run


def _near(lo1, hi1, lo2, hi2, epsilon: float) -> bool:
    gap = np.maximum(0, np.maximum(lo1 - hi2, lo2 - hi1))
    return float((gap * gap).sum()) <= (epsilon + 1e-9) ** 2


def join_intervals(ids, weights, vectors, z, split: int, cosine: float, epsilon: float, leaf: int = LEAF):
    """Links between rows before ``split`` and after it (or of all rows with each other, if it is 0).

    Gives the added weight of links of each row, and links that join its components."""
    n = len(ids)
    count, up, links = np.zeros(n, np.int64), np.arange(n), []

    def find(i):
        while up[i] != i:
            up[i] = up[up[i]]
            i = up[i]
        return i

    todo = [(0, n, 0, n)] if not split else [(0, split, split, n)]
    while todo:
        a, b, c, d = todo.pop()
        if not _near(z[a:b].min(axis=0), z[a:b].max(axis=0), z[c:d].min(axis=0), z[c:d].max(axis=0), epsilon):
            continue
        if max(b - a, d - c) > leaf:
            if (a, b) == (c, d):
                m = (a + b) // 2
                todo += [(a, m, a, m), (m, b, m, b), (a, m, m, b)]
            elif b - a >= d - c:
                m = (a + b) // 2
                todo += [(a, m, c, d), (m, b, c, d)]
            else:
                m = (c + d) // 2
                todo += [(a, b, c, m), (a, b, m, d)]
            continue
        hit = vectors[a:b] @ vectors[c:d].T >= cosine
        if (a, b) == (c, d):
            np.fill_diagonal(hit, False)
            count[a:b] += hit @ weights[c:d]
            hit = np.triu(hit)
        else:
            count[a:b] += hit @ weights[c:d]
            count[c:d] += weights[a:b] @ hit
        for i, j in zip(*np.nonzero(hit), strict=True):
            p, q = find(a + i), find(c + j)
            if p != q:
                up[max(p, q)] = min(p, q)
                links.append((int(ids[a + i]), int(ids[c + j])))
    return count, links


def _join(axes: dict[int, np.ndarray], cosine: float, epsilon: float):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                own = row["block"] == row["block2"]
                d = row["d"]
                sides = [""] if own else ["", "2"]
                ids = np.concatenate([np.frombuffer(row["ids" + s], np.int64) for s in sides])
                weights = np.concatenate([np.frombuffer(row["weights" + s], np.int64) for s in sides])
                vectors = np.concatenate([_unit(row["vectors" + s], d) for s in sides])
                split = 0 if own else len(row["ids"]) // 8
                count, links = join_intervals(ids, weights, vectors, vectors @ _axes(axes, d).T, split, cosine, epsilon)
                some = np.flatnonzero(count)
                a = [*ids[some].tolist(), *[x for x, _ in links]]
                b = [*[None] * len(some), *[y for _, y in links]]
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64()), pa.array([*count[some].tolist(), *[0] * len(links)], pa.int64())], names=["a", "b", "n"])

    return run


def near_vectors(vectors: DataFrame, *, cosine: float = COSINE, interval: int = INTERVAL, sample: int = SAMPLE, count: int = DIRECTIONS) -> DataFrame:
    """(vec_id, n_links, component_id, kept) for each row of vec_id, embedding and label."""
    spark = vectors.sparkSession
    scratch = Scratch(spark, "vectors")
    epsilon = float(np.sqrt(2 - 2 * cosine))
    v = F.transform("embedding", lambda x: x.cast("double"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), v.alias("v"))
    good = rows.where(F.col("label").isNotNull() & F.coalesce(usable(F.col("v")), F.lit(False)))
    good = good.withColumns({"g1": F.xxhash64("label", "v"), "g2": F.xxhash64(F.lit(0x5EED), F.col("label"), F.col("v"))})
    # One point for equal vectors; its node is a number of its own, as vec_ids may be null or repeat.
    points = scratch.write(good.groupBy("g1", "g2").agg(F.any_value("label").alias("label"), F.any_value("v").alias("v"), F.min("vec_id").alias("least"), F.count(F.lit(1)).alias("weight")))
    points = scratch.write(points.withColumn("id", F.monotonically_increasing_id()))
    axes = directions(points, sample, count)
    names = [f"c{k}" for k in range(count)]
    cells = points.select("id", "label", "weight", "v").mapInArrow(_cells(axes, epsilon, count), "id long, label long, weight long, v array<double>, " + ", ".join(f"{c} long" for c in names))
    order = ["label", F.size("v"), *names, "id"]
    ordered = cells.repartitionByRange(*order).sortWithinPartitions(*order)
    blocks = scratch.write(ordered.select("id", "label", "weight", "v").mapInArrow(_intervals(axes, epsilon, interval), _BLOCK))
    slim = blocks.select("block", "label", "d", "lo", "hi", "first", "last")
    left = slim.withColumn("cell", F.explode(F.sequence("first", "last")))
    right = slim.select(*[F.col(c).alias(c + "2") for c in slim.columns]).withColumn("cell2", F.explode(F.sequence(F.col("first2") - 1, F.col("last2") + 1)))
    gap = F.aggregate(F.zip_with(F.arrays_zip("lo", "hi"), F.arrays_zip("lo2", "hi2"), lambda x, y: F.greatest(F.lit(0.0), x["lo"] - y["hi2"], y["lo2"] - x["hi"])), F.lit(0.0), lambda s, x: s + x * x)
    met = left.join(right, (F.col("label") == F.col("label2")) & (F.col("d") == F.col("d2")) & (F.col("cell") == F.col("cell2")) & (F.col("block") <= F.col("block2")))
    met = met.where(gap <= (epsilon + 1e-9) ** 2).select("block", "block2").distinct()
    body = blocks.select("block", "d", "ids", "weights", "vectors")
    other = blocks.select(F.col("block").alias("block2"), F.col("ids").alias("ids2"), F.col("weights").alias("weights2"), F.col("vectors").alias("vectors2"))
    found = scratch.write(met.join(body, "block").join(other, "block2").mapInArrow(_join(axes, cosine, epsilon), "a long, b long, n long"))
    counts = found.where("b IS NULL").groupBy("a").agg(F.sum("n").alias("n"))
    stars = components(found.where("b IS NOT NULL").select("a", "b"), scratch)
    node = points.select("g1", "g2", "id", "least", "weight").join(counts, F.col("id") == F.col("a"), "left").join(stars, F.col("id") == F.col("node"), "left")
    node = scratch.write(node.select("g1", "g2", F.coalesce("component", "id").alias("node"), "least", (F.coalesce("n", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
    least = scratch.write(node.groupBy("node").agg(F.min("least").alias("component_id")))
    named = node.join(least, "node").select("g1", "g2", "n_links", "component_id")
    linked = good.select("vec_id", "g1", "g2").join(named, ["g1", "g2"]).select("vec_id", "n_links", "component_id")
    rest = rows.where(F.col("label").isNull() | ~F.coalesce(usable(F.col("v")), F.lit(False))).select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return linked.unionByName(rest).withColumn("kept", F.coalesce(F.col("vec_id") == F.col("component_id"), F.lit(False)))


def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_vectors(table(spark, sf_dir, "embeddings"))
