"""The corpus pipeline: documents that are not toxic, without repeated lines and near copies, mixed
to target weights and packed into training sequences.

Each stage takes (spark, docs, sf_dir); its result is written as Parquet and read again as the next
stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm import jaccard_join, line_dedup, mixing, packing, toxicity
from logweir.llm.common import Scratch, table, unused


def keep_ordinary(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents scored as toxic go; the models are fitted to labelled documents of the input."""
    scorer = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    (score,) = unused(docs, "__score")
    return toxicity.scored(docs, scorer, column=score).where(F.col(score) < toxicity.THRESHOLD).drop(score)


def drop_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that several documents hold stay in one of them; n_chars follows the text."""
    out = line_dedup.drop_repeated_lines(docs)
    kind, dropped = docs.schema["n_chars"].dataType, out.columns[-1]
    return out.withColumn("n_chars", F.when(F.col(dropped) > 0, F.length("text").cast(kind)).otherwise(F.col("n_chars"))).select(*[F.col(f"`{c}`") for c in docs.columns])


def keep_one(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies stays."""
    return jaccard_join.keep_one(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in training order, repeated or left out as the targets of their sources ask."""
    return mixing.curriculum(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of documents in sequences of the window's length."""
    return packing.pack(docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", keep_ordinary),
    ("line dedup", drop_lines),
    ("n-gram jaccard join", keep_one),
    ("mixing sources to target weights", mix),
    ("packing", pack),
]

#: Trained scores and bin packing have no SQL form.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES[:-1]):
        before = docs
        with Scratch.group() as opened:
            docs = scratch.write(stage(spark, docs, sf_dir))
        # Nothing reads the stage's own tables, or its input, any more.
        Scratch.discard(opened)
        if k:
            scratch.drop(before)
    return STAGES[-1][1](spark, docs, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
