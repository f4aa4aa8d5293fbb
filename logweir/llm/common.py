"""Shared pieces of the training-data operators: reading tables, shared scratch tables, text keys."""

from __future__ import annotations

import atexit
import uuid
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.storage import delete, shared_dir

#: The six characters that separate words and are stripped from lines.
BLANKS = "\t\n\x0b\x0c\r "
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def sheltered(docs: DataFrame, *keep: str) -> tuple[DataFrame, dict[str, str]]:
    """``docs`` with other names for all columns but ``keep``, which no working column has, and those
    names by the columns' own."""
    names = {c: c if c in keep else f"other{i}" for i, c in enumerate(docs.columns)}
    return docs.select(*[F.col(f"`{c}`").alias(n) for c, n in names.items()]), names


def unused(docs: DataFrame, *names: str) -> list[str]:
    """``names``, each with underscores in front until ``docs`` has no such column."""
    taken, out = {c.lower() for c in docs.columns}, []
    for name in names:
        while name.lower() in taken:
            name = "_" + name
        out.append(name)
    return out


class Scratch:
    """Tables written to the shared folder, to cut lineage and to outlive lost executors.

    They stay as long as a result may read them: to the end of the program, or, where they were opened
    in a ``group``, until it is discarded."""

    _opened: list["Scratch"] = []
    _group: ContextVar[list["Scratch"] | None] = ContextVar("group", default=None)

    def __init__(self, spark: SparkSession, name: str):
        self.spark, self.root = spark, f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
        self.count = 0
        group = Scratch._group.get()
        if group is not None:
            group.append(self)
            return
        if not Scratch._opened:
            atexit.register(Scratch.discard, Scratch._opened)
        Scratch._opened.append(self)

    @staticmethod
    @contextmanager
    def group() -> Iterator[list["Scratch"]]:
        """What this thread opens inside, for ``discard``; other threads' tables are their own."""
        opened: list[Scratch] = []
        token = Scratch._group.set(opened)
        try:
            yield opened
        finally:
            Scratch._group.reset(token)

    @staticmethod
    def discard(opened: list["Scratch"]) -> None:
        """Deletes the tables of all that were opened."""
        while opened:
            scratch = opened.pop()
            try:
                delete(scratch.spark, scratch.root)
            except Exception:
                # The session may be gone; then what is left is the owner of the folder's to remove.
                return

    def write(self, df: DataFrame) -> DataFrame:
        self.count += 1
        path = f"{self.root}/{self.count}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        out.scratch_path = path
        return out

    def drop(self, df: DataFrame) -> None:
        """Deletes a table of this scratch that no later step reads."""
        delete(self.spark, df.scratch_path)


class Recent(dict):
    """What a worker keeps by word: words met lately, in two generations of about ``size``.

    A full generation becomes the old one, and the old one's words that are not met again go with
    it. Most distinct words of a corpus occur once, so a bound costs little; workers outlive their
    tasks and stages, so without one each holds what all of them met."""

    def __init__(self, size: int):
        self.size, self.old = size, {}

    def __missing__(self, word):
        value = self[word] = self.old[word]
        return value

    def absent(self, words: Iterable) -> list:
        """Those of ``words`` that neither generation holds."""
        old = self.old
        return [w for w in words if w not in self and w not in old]

    def age(self) -> None:
        """Begins a generation if this one is full; no word may be in use meanwhile."""
        if len(self) > self.size:
            self.old = dict(self)
            self.clear()


#: Rows of a batch that become Python objects at once.
SLICE = 500


def slices(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows of ``batches`` in small batches, which share their memory."""
    for batch in batches:
        for start in range(0, batch.num_rows, SLICE):
            yield batch.slice(start, SLICE)


def ascii_lower(text: Column) -> Column:
    """Lower-cases A-Z only.

    ``lower`` is right, and several times faster than ``translate``, for texts whose other
    characters have no lower-case form of their own; the rest take ``translate``.
    """
    plain = (F.octet_length(text) == F.length(text)) | ~text.rlike("[^\\x00-\\x7F\\u00DF-\\u00FF]")
    return F.when(plain, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def wide_hash(text: Column) -> list[Column]:
    """Two independent 64-bit hashes: together no two texts of a corpus collide in practice."""
    return [F.xxhash64(text), F.xxhash64(F.lit(0x5EED), text)]


def least_hashes(rows: DataFrame, hashed: str, size: int) -> DataFrame:
    """At most ``size`` rows, those with the least values of a 64-bit hash column.

    Rows beyond a share that holds half as many again are dropped where they lie, so that a top-k
    over many tasks gathers little more than ``size`` rows, however large the table."""
    share = 1.5 * (size + 100) / max(1, rows.count())
    if share < 1:
        rows = rows.where(F.col(hashed) < F.lit(int((share - 0.5) * 2**64)))
    return rows.orderBy(hashed, *[c for c in rows.columns if c != hashed]).limit(size)
