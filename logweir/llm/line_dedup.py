"""Line dedup, native: explode hashed lines, count distinct documents per hash, drop, reassemble.

Plan. Lines are exploded as (document, position, 128-bit hash of the normalised line); the line
text itself never enters a shuffle. Distinct (hash, document) pairs are counted by a two-step
aggregation whose second step combines before its exchange, so a line held by a third of all
documents reaches the final task as one partial row from each task. Hashes over the threshold are
joined back to the (document, position) rows by a plain inner equi-join, the shape that adaptive
execution splits where a hash is hot. Each document then meets its list of dropped positions once.

Edge cases. A null or empty text is one empty line. Keys shorter than ``min_length`` code points
are never dropped. Rows that repeat a doc_id count as one document; each row is returned, and a
key is kept or dropped alike in all of them. Null doc_ids count as one document that sorts before
all others. Extra columns of any name pass through ``drop_repeated_lines`` untouched. An empty table
gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.llm.common import BLANKS, Scratch, ascii_lower, sheltered, table, unused, wide_hash

MIN_LENGTH, MIN_DOCS = 20, 3


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


def dropped_positions(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """(__id, __row, __at): for each document the sorted positions of the lines to drop."""
    # The exploded line is short, so its key is computed once a line inside generated code.
    lines = docs.select(F.col("doc_id").alias("__id"), F.xxhash64("text").alias("__row"), F.posexplode(_lines(F.col("text"))).alias("__pos", "__line"))
    trimmed = F.btrim(F.col("__line"), F.lit(BLANKS))
    keyed = lines.select("__id", "__row", "__pos", trimmed.alias("__t")).where(F.length("__t") >= min_length)
    h1, h2 = wide_hash(ascii_lower(F.col("__t")))
    keyed = keyed.select("__id", "__row", "__pos", h1.alias("__h1"), h2.alias("__h2"))
    holders = keyed.select("__h1", "__h2", "__id").distinct()
    # max() skips nulls: a null doc_id is the last holder only where no other document holds the key.
    over = holders.groupBy("__h1", "__h2").agg(F.count(F.lit(1)).alias("__n"), F.max("__id").alias("__last")).where(F.col("__n") >= min_docs).select("__h1", "__h2", "__last")
    # Written out, the few keys over the threshold have no partitioning of their own that the join
    # would have to keep: adaptive execution is free to split a hot key, or to broadcast by size.
    over = Scratch(docs.sparkSession, "lines").write(over)
    hit = keyed.join(over, ["__h1", "__h2"]).where(~F.col("__id").eqNullSafe(F.col("__last")))
    return hit.groupBy("__id", "__row").agg(F.collect_set("__pos").alias("__at"))


def drop_repeated_lines(docs: DataFrame, *, min_length: int = MIN_LENGTH, min_docs: int = MIN_DOCS) -> DataFrame:
    """``docs`` with ``text`` rebuilt, and two columns behind it: ``__n_lines`` and ``__n_dropped``, with
    more underscores in front where ``docs`` has columns of these names."""
    every, added = docs.columns, unused(docs, "__n_lines", "__n_dropped")
    docs, inner = sheltered(docs, "doc_id", "text")
    at = dropped_positions(docs, min_length=min_length, min_docs=min_docs).withColumnsRenamed({"__id": "__d", "__row": "__r"})
    rows = docs.withColumn("__row", F.xxhash64("text"))
    joined = rows.join(at, rows["doc_id"].eqNullSafe(at["__d"]) & (rows["__row"] == at["__r"]), "left")
    parts = _lines(F.col("text"))
    count = F.size(parts)
    kept = F.array_except(F.sequence(F.lit(0), count - 1), F.col("__at"))
    rebuilt = F.array_join(F.transform(kept, lambda i: F.get(parts, i)), "\n")
    gone = F.coalesce(F.size("__at"), F.lit(0))
    text = F.when(F.col("__at").isNotNull(), rebuilt).otherwise(F.col("text"))
    return joined.select(
        *[(text if c == "text" else F.col(inner[c])).alias(c) for c in every],
        count.cast("long").alias(added[0]),
        F.when(F.col("__at").isNull(), 0).otherwise(gone).cast("long").alias(added[1]),
    )


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drop_repeated_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return out.select(
        "doc_id",
        F.col("__n_lines").alias("n_lines"),
        F.col("__n_dropped").alias("n_dropped"),
        F.sha2(F.encode(F.coalesce(F.col("text"), F.lit("")), "UTF-8"), 256).alias("kept_sha256"),
    )


#: DuckDB strips with a character list and lower-cases A-Z with translate, as the operator does.
_KEY = "translate(trim(line, chr(9)||chr(10)||chr(11)||chr(12)||chr(13)||' '), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP1_SQL = f"""
WITH l AS (
  SELECT doc_id, unnest(p) AS line, generate_subscripts(p, 1) AS pos
  FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS p FROM documents)
), k AS (SELECT doc_id, pos, line, {_KEY} AS key FROM l),
over AS (
  SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= {MIN_LENGTH}
  GROUP BY key HAVING count(DISTINCT doc_id) >= {MIN_DOCS}
), m AS (
  SELECT k.doc_id, pos, line, over.key IS NOT NULL AND k.doc_id <> over.last AS gone
  FROM k LEFT JOIN over ON k.key = over.key
)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
