"""Mixing sources to target weights, native: a time-varying curriculum.

Targets. Sources share all words by weight; a source's target stops at ``max_repeats`` times its
own size and the excess is shared again by weight. That fixed point is a water level: with sources
sorted by size / weight, the capped ones are a prefix, found with two running sums over one row a
source, so no loop is needed.

Curriculum. Each source has a schedule whose weight runs linearly from ``start`` to ``end`` over
the training time 0..1. Its integral, scaled to the target, is the source's cumulative demand.
Documents of a source stand in a fixed pseudo-random order (md5 of doc_id), over and over. A
document's copy that starts after ``c`` of the source's words gets the position at which the demand
reaches ``c``, by inverting the integral in closed form; where the demand never comes so far by the
end of training, it has no position. What a copy gives is the demand between its own position and that at which it ends,
or the end of training: so the last copy is cut. Copies are range-sorted by position.

Scale. Running sums over a source are taken in two steps: 4096 buckets of the md5 order give
bucket totals and their running sum, then each (source, bucket) is summed alone. A source with a
third of all rows is spread over all its buckets. Tables of one row a source join by size-checked
broadcast or by an equi-join that adaptive execution may split.

Edge cases. A null or blank text has size 0 and takes 0. Null sources form one source, ordered
last. A null doc_id sorts as an empty string. Repeated rows are separate documents; equal ones are
interchangeable, so reruns agree. If all sizes are 0, all targets are 0. An empty table gives an
empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from logweir.llm.common import sheltered, table, unused

WEIGHTS = (5, 2, 1)
MAX_REPEATS = 3
#: Schedule of each weight class, as (start, end) multiples: heavy sources fade, light ones grow.
SCHEDULES = ((1.5, 0.5), (1.0, 1.0), (0.5, 1.5))
WORD = "[^\\x20\\x09-\\x0D]+"


def word_count(text: Column) -> Column:
    """Words are runs of other characters than the six blanks."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def source_targets(sizes: DataFrame, *, weights=WEIGHTS, max_repeats: int = MAX_REPEATS) -> DataFrame:
    """From (source, source_size) rows: (source, source_size, rank, weight, target)."""
    rank = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), (F.col("rank") % len(weights) + 1).cast("int"))
    cap = F.col("source_size") * max_repeats
    ranked = sizes.withColumn("rank", rank).withColumn("weight", weight.cast("long")).withColumn("cap", cap)
    filling = Window.orderBy((F.col("cap") / F.col("weight")).asc(), F.col("rank").asc())
    below, onward = filling.rowsBetween(Window.unboundedPreceding, -1), filling.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    level = (F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(below), F.lit(0))) / F.sum("weight").over(onward)
    found = ranked.withColumn("__level", level)
    # The first source, in filling order, that the level computed for it does not cap.
    fits = F.when(F.col("__level") <= F.col("cap") / F.col("weight"), F.col("__level"))
    found = found.withColumn("__level", F.max(fits).over(everything))
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("__level") * F.col("weight"), F.col("cap").cast("double")))
    return found.select("source", "source_size", "rank", "weight", target.alias("target"))


def _by_rank(rank: Column, schedules, of) -> Column:
    """``of(start, end)`` of the schedule of a source's rank."""
    out = None
    for k, (a, b) in enumerate(schedules):
        case = rank % len(schedules) == k
        out = F.when(case, of(a, b)) if out is None else out.when(case, of(a, b))
    return out


def _position(share: Column, rank: Column, schedules) -> Column:
    """Inverts the integral of a linear schedule: the time at which ``share`` of the demand is met."""
    return _by_rank(rank, schedules, lambda a, b: share if a == b else (F.sqrt(F.lit(float(a * a)) + F.lit(float(b * b - a * a)) * share) - F.lit(float(a))) / F.lit(float(b - a)))


def _demand(at: Column, rank: Column, schedules) -> Column:
    """The share of a source's demand up to a time: the integral of its schedule."""
    return _by_rank(rank, schedules, lambda a, b: (F.lit(float(a)) * at + F.lit((b - a) / 2.0) * at * at) / F.lit((a + b) / 2.0))


_ADDED = ["__size", "__source_size", "__target", "__copies", "__taken"]
_READ = ["doc_id", "text", "source", "n_chars"]


def mixed(docs: DataFrame, *, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """``docs`` plus __size, __source_size, __target, __copies and __taken, their words together; with
    more underscores in front where ``docs`` has such columns. __copies has the training position and
    the words of each copy in training, in order. ``docs`` needs doc_id, text and source; other columns, of
    any name, pass through."""
    inner, names = sheltered(docs, *_READ)
    out = _mixed(inner, weights, max_repeats, schedules)
    return out.select(*[F.col(n).alias(c) for c, n in names.items()], *[F.col(c).alias(n) for c, n in zip(_ADDED, unused(docs, *_ADDED), strict=True)])


def _mixed(docs: DataFrame, weights, max_repeats: int, schedules) -> DataFrame:
    order = F.md5(F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    rows = docs.withColumns({"__size": word_count(F.col("text")), "__key": order, "__row": F.xxhash64("text")})
    rows = rows.withColumn("__bucket", F.substring("__key", 1, 3))
    slim = docs.select("source", word_count(F.col("text")).alias("__size"), F.substring(order, 1, 3).alias("__bucket"))
    buckets = slim.groupBy("source", "__bucket").agg(F.sum("__size").alias("__held"))
    sources = source_targets(buckets.groupBy("source").agg(F.sum("__held").alias("source_size")), weights=weights, max_repeats=max_repeats)
    upto = Window.partitionBy("source").orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = buckets.withColumn("__start", F.coalesce(F.sum("__held").over(upto), F.lit(0))).drop("__held")
    s = sources.select(F.col("source").alias("__s"), "source_size", F.col("rank").alias("__rank"), "target")
    starts = starts.join(s, starts["source"].eqNullSafe(s["__s"])).select(F.col("source").alias("__src"), F.col("__bucket").alias("__b"), "__start", "source_size", "__rank", "target")
    starts = starts.withColumnsRenamed({"source_size": "__source_size", "target": "__target"})
    own = Window.partitionBy("source", "__bucket").orderBy("__key", "doc_id", "__size", "__row").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum("__size").over(own), F.lit(0)))
    rows = rows.join(starts, rows["source"].eqNullSafe(starts["__src"]) & (rows["__bucket"] == starts["__b"]))
    before = F.col("__start") + F.col("__inside")
    goal = F.floor("__target").cast("long")
    rows = rows.withColumns({"__before": before.cast("long"), "__goal": goal})
    # A copy for each time that the source's words begin anew before the goal.
    times = F.when((F.col("__size") > 0) & (F.col("__before") < goal), F.sequence(F.lit(0).cast("long"), F.floor((goal - 1 - F.col("__before")) / F.col("__source_size")).cast("long")))

    def copy(epoch: Column) -> Column:
        begins = epoch * F.col("__source_size") + F.col("__before")
        return F.struct(epoch.alias("epoch"), _position(begins / F.col("__target"), F.col("__rank"), schedules).alias("at"), _position(F.least(begins + F.col("__size"), goal) / F.col("__target"), F.col("__rank"), schedules).alias("until"))

    def words(c: Column) -> Column:
        # Whole words: doubles hold the demand to far less than half a word.
        met = F.col("__target") * (_demand(c["until"], F.col("__rank"), schedules) - _demand(c["at"], F.col("__rank"), schedules))
        return F.struct(c["epoch"].alias("epoch"), c["at"].alias("at"), F.round(met).cast("long").alias("words"))

    rows = rows.withColumn("__copies", F.coalesce(F.transform(F.transform(times, copy), words), F.array().cast("array<struct<epoch:bigint,at:double,words:bigint>>")))
    return rows.select(
        *[F.col(f"`{c}`") for c in docs.columns],
        "__size", "__source_size", "__target", "__copies",
        F.aggregate("__copies", F.lit(0).cast("long"), lambda s, c: s + c["words"]).alias("__taken"),
    )


def curriculum(docs: DataFrame, *, weights=WEIGHTS, max_repeats: int = MAX_REPEATS, schedules=SCHEDULES) -> DataFrame:
    """The training order: one row a copy of a document, with the columns of ``docs``, sorted by
    position. The copy that the target cuts keeps its first words only, up to the cut."""
    columns = docs.columns
    docs, names = sheltered(docs, *_READ)
    m = _mixed(docs, weights, max_repeats, schedules)
    copies = m.withColumn("__copy", F.explode("__copies"))
    cut = F.col("__copy.words") < F.col("__size")
    words = F.slice(F.regexp_extract_all("text", F.lit(f"({WORD})"), 1), F.lit(1), F.col("__copy.words").cast("int"))
    text = F.when(cut, F.array_join(words, " ")).otherwise(F.col("text"))
    copies = copies.withColumn("text", text)
    if "n_chars" in docs.columns:
        copies = copies.withColumn("n_chars", F.when(cut, F.length("text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars")))
    return copies.orderBy("__copy.at", "doc_id", "__copy.epoch").select(*[F.col(names[c]).alias(c) for c in columns])


def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = mixed(table(spark, sf_dir, "documents").select("doc_id", "text", "source"))
    at = F.transform("__copies", lambda c: c["at"])
    out = m.select(
        "doc_id", F.col("__size").alias("size"), F.col("__source_size").alias("source_size"), F.col("__target").alias("target"), F.col("__taken").alias("taken"),
        F.size("__copies").cast("long").alias("n_copies"), F.round(F.get(at, F.lit(0)), 9).alias("first_position"), F.round(F.get(at, F.size("__copies") - 1), 9).alias("last_position"),
    )
    return out.orderBy(F.col("first_position").asc_nulls_last(), "doc_id")


def _sql_position(begins: str) -> str:
    cases = [f"WHEN {k} THEN " + (f"({begins}) / target" if a == b else f"(sqrt({a * a}::DOUBLE + {b * b - a * a}::DOUBLE * (({begins}) / target)) - {a}::DOUBLE) / {b - a}::DOUBLE") for k, (a, b) in enumerate(SCHEDULES)]
    return f"CASE WHEN n_copies > 0 THEN round(CASE r % {len(SCHEDULES)} {' '.join(cases)} END, 9) END"


OP3_SQL = f"""
WITH d AS (
  SELECT doc_id, source, md5(coalesce(doc_id::VARCHAR, '')) AS k,
         coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::BIGINT AS size
  FROM documents
), s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS r
  FROM d GROUP BY source
), w AS (
  SELECT *, CASE r % 3 WHEN 0 THEN 5 WHEN 1 THEN 2 ELSE 1 END AS weight, source_size * {MAX_REPEATS} AS cap FROM s
), l AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / weight, r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE
            / sum(weight) OVER (ORDER BY cap / weight, r ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM w
), v AS (SELECT *, max(CASE WHEN level <= cap / weight THEN level END) OVER () AS water FROM l),
t AS (SELECT source, source_size, r, least(cap::DOUBLE, coalesce(water * weight, cap::DOUBLE)) AS target FROM v),
x AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, t.r, floor(t.target)::BIGINT AS goal,
         coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY k, d.doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
       (CASE WHEN source_size > 0 THEN (goal // source_size) * size
        + greatest(0, least(size, goal - (goal // source_size) * source_size - before)) ELSE 0 END)::BIGINT AS taken,
       n_copies, {_sql_position("before")} AS first_position, {_sql_position("(n_copies - 1) * source_size + before")} AS last_position
FROM (SELECT *, CASE WHEN size > 0 AND before < goal THEN (goal - 1 - before) // source_size + 1 ELSE 0 END::BIGINT AS n_copies FROM x)
"""
