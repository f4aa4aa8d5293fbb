"""Queries over the tables of a folder, each with its SQL equivalent.

The log is the table ``events``; holes and placeholders, which it lacks, are derived from ids. "Now"
is a fixed time, so that results do not change.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from logweir.functions import ages, blobs, ids, traces
from logweir.operators import batching, cursors, filters, gaps, health, log, progress, retries, shards, waiting
from logweir.operators.ordering import with_position
from logweir.options import StreamOptions
from logweir.schema import EventColumns
from logweir.sources import polling, tables
from logweir.sources.blobs import Bucket
from logweir.sources.cache import TailCache
from logweir.sources.stored import ErrorStore, StoredLog, append_parquet, fill_gaps
from logweir.storage import shared_dir
from logweir.streaming import patterns
from logweir.streaming.run import Consumer, Spec, run

Query = Callable[[SparkSession, str], DataFrame]
_QUERIES: dict[str, Query] = {}
_SQL: dict[str, str] = {}

NOW = "2024-01-20 00:00:00"
EVENT = ["id", "type", "foreign_id", "ts", "metadata"]
LOG = """log AS (SELECT event_id + 1 AS id, CASE event_type WHEN 'click' THEN 1 WHEN 'error' THEN 2 WHEN 'purchase' THEN 3
 WHEN 'signup' THEN 4 WHEN 'view' THEN 5 ELSE 0 END AS type, CAST(user_id AS VARCHAR) AS foreign_id, ts, props AS metadata, value FROM events)"""
NOOPS = "noops AS (SELECT id, CASE WHEN id % 50 = 0 THEN 0 ELSE type END AS type, CASE WHEN id % 50 = 0 THEN '0' ELSE foreign_id END AS foreign_id, ts, metadata FROM log)"
HOLES = "holes AS (SELECT * FROM log WHERE (id - 1) % 997 <> 996)"
FNV = "list_reduce(list_concat([2166136261::BIGINT], list_transform(range(1, strlen({k}) + 1), lambda place: ('0x' || substr(hex(encode({k})), (2 * place - 1)::INT, 2))::BIGINT)), lambda h, b: xor((h * 16777619) & 4294967295, b))"


def query(sql: str | None = None):
    def add(fn: Query) -> Query:
        _QUERIES[fn.__name__] = fn
        if sql:
            _SQL[fn.__name__] = sql
        return fn

    return add


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _log(spark: SparkSession, folder: str) -> DataFrame:
    return tables.events(spark, folder)


def _plain(events: DataFrame) -> DataFrame:
    """Comparable columns: time without zone, metadata as text."""
    return events.select("id", "type", "foreign_id", F.col("timestamp").cast("timestamp_ntz").alias("ts"), F.col("metadata").cast("string").alias("metadata"))


def _noops(spark: SparkSession, folder: str) -> DataFrame:
    hit = F.col("id") % 50 == 0
    return _log(spark, folder).withColumns({"type": F.when(hit, 0).otherwise(F.col("type")), "foreign_id": F.when(hit, "0").otherwise(F.col("foreign_id"))})


def _holes(spark: SparkSession, folder: str) -> DataFrame:
    return _log(spark, folder).where((F.col("id") - 1) % 997 != 996)


def _now():
    return F.lit(NOW).cast("timestamp")


# Pages, head, lag.


@query(f"WITH {LOG} SELECT id, type, foreign_id, ts, metadata FROM log WHERE id > 500 ORDER BY id LIMIT 1000")
def log_page(spark, folder):
    return _plain(log.page(_log(spark, folder), 500))


@query(f"WITH {LOG} SELECT coalesce(max(id), 0)::BIGINT AS head FROM log")
def log_head(spark, folder):
    return log.head(_log(spark, folder))


@query(f"WITH {LOG} SELECT id, type, foreign_id, ts, metadata FROM log WHERE id > (SELECT max(id) FROM log WHERE ts < TIMESTAMP '{NOW}')")
def log_from_head(spark, folder):
    """Opened at NOW: what came later."""
    events = _log(spark, folder)
    head = log.head(events.where(F.col("timestamp") < _now()))
    return _plain(events.where(F.col("id") > head.scalar()))


@query(f"WITH {LOG} SELECT count(*) AS n, min(id) AS first_id, max(id) AS last_id FROM log WHERE id > 700")
def log_to_head_count(spark, folder):
    return log.after(_log(spark, folder), 700).agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))


@query(f"WITH {LOG} SELECT id, type, foreign_id, ts, metadata FROM log WHERE ts < TIMESTAMP '{NOW}' - INTERVAL 2 HOUR")
def log_lag_strict(spark, folder):
    return _plain(log.lagged(_log(spark, folder), _now(), F.expr("INTERVAL 2 HOURS")))


@query(f"WITH {LOG} SELECT id, ts FROM log WHERE id < coalesce((SELECT min(id) FROM log WHERE ts > TIMESTAMP '{NOW}' - INTERVAL 2 HOUR), 9223372036854775807)")
def log_lag_prefix(spark, folder):
    return log.lagged_prefix(_log(spark, folder), _now(), F.expr("INTERVAL 2 HOURS")).select("id", F.col("timestamp").cast("timestamp_ntz").alias("ts"))


@query(f"WITH {LOG}, {NOOPS} SELECT id, type, foreign_id, ts, metadata FROM noops WHERE NOT (foreign_id = '0' AND type = 0)")
def noop_filtered(spark, folder):
    return _plain(log.without_noops(_noops(spark, folder)))


@query(f"WITH {LOG}, {NOOPS} SELECT id, type, foreign_id FROM noops")
def noop_included(spark, folder):
    """The log as a stream that keeps its placeholders."""
    return log.EventLog(lambda _: _noops(spark, folder), EventColumns(metadata="metadata", trace="trace"), include_noops=True).stream(spark).select("id", "type", "foreign_id")


@query(f"WITH {LOG}, {NOOPS}, p AS (SELECT * FROM noops WHERE id > 300 ORDER BY id LIMIT 200) SELECT count(*) FILTER (WHERE NOT (foreign_id = '0' AND type = 0)) AS returned, count(*) FILTER (WHERE foreign_id = '0' AND type = 0) AS dropped, coalesce(max(id), 300)::BIGINT AS next_cursor FROM p")
def noop_page_override(spark, folder):
    return log.page_with_override(_noops(spark, folder), 300, 200)


@query(f"WITH {LOG} SELECT id, type, foreign_id, NULL::VARCHAR AS metadata FROM log")
def projection_without_metadata(spark, folder):
    from logweir.schema import EventColumns

    rows = EventColumns().read(_log(spark, folder))
    return rows.select("id", "type", "foreign_id", F.col("metadata").cast("string").alias("metadata"))


# Gaps.


@query(f"WITH {LOG}, {HOLES}, p AS (SELECT lag(id) OVER (ORDER BY id) AS prev, id AS next FROM holes) SELECT prev, next FROM p WHERE next <> prev + 1")
def gap_list(spark, folder):
    return gaps.gaps(_holes(spark, folder))


@query(f"WITH {LOG}, {HOLES}, p AS (SELECT lag(id) OVER (ORDER BY id) AS prev, id AS next FROM holes), f AS (SELECT min(next) AS stop FROM p WHERE next <> prev + 1) SELECT id, ts FROM holes, f WHERE stop IS NULL OR id < stop")
def gap_prefix(spark, folder):
    return gaps.contiguous(_holes(spark, folder)).select("id", F.col("timestamp").cast("timestamp_ntz").alias("ts"))


@query(f"WITH {LOG}, {HOLES}, p AS (SELECT lag(id) OVER (ORDER BY id) AS prev, id AS next, ts FROM holes), m AS (SELECT unnest(range(prev + 1, next)) AS id, ts FROM p WHERE next <> prev + 1) SELECT id, type, foreign_id, ts, metadata FROM holes UNION ALL SELECT id, 0, '0', ts, NULL FROM m")
def gap_fill(spark, folder):
    return _plain(gaps.filled(_holes(spark, folder)))


def _behind(cursor: int) -> str:
    return f"(SELECT id FROM holes WHERE id > {cursor} AND id < coalesce((SELECT min(next) FROM (SELECT coalesce(lag(id) OVER (ORDER BY id), {cursor}) AS prev, id AS next FROM holes WHERE id > {cursor}) WHERE next <> prev + 1), 9223372036854775807))"


@query(f"WITH {LOG}, {HOLES} SELECT 990 AS cursor, id FROM {_behind(990)} UNION ALL SELECT 996, id FROM {_behind(996)} UNION ALL SELECT 997, id FROM {_behind(997)}")
def gap_to_head(spark, folder):
    """Cursors some events before a hole, right before it, and in it."""
    held = _holes(spark, folder)
    parts = [gaps.contiguous(held, c).select(F.lit(c).alias("cursor"), "id") for c in (990, 996, 997)]
    return parts[0].union(parts[1]).union(parts[2])


@query(f"WITH {LOG}, l AS (SELECT id FROM log WHERE id >= 100), p AS (SELECT lag(id) OVER (ORDER BY id) AS prev, id AS next FROM l) SELECT 'empty' AS cursor, count(*) FILTER (WHERE prev IS NOT NULL AND next <> prev + 1) AS n FROM p UNION ALL SELECT 'set', count(*) FILTER (WHERE next <> coalesce(prev, 98) + 1) FROM p")
def gap_empty_cursor_vs_cursor(spark, folder):
    late = _log(spark, folder).where("id >= 100")
    one = lambda name, c: gaps.gaps(late, c).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("cursor"), "n")
    return one("empty", 0).union(one("set", 98))


@query(f"WITH {LOG} SELECT id, type FROM log")
def log_order_check(spark, folder):
    return log.checked_increasing(_log(spark, folder).orderBy("id")).select("id", "type")


# Filters.


@query(f"WITH {LOG} SELECT id, type FROM log WHERE type IN (1, 3)")
def filter_types(spark, folder):
    return filters.include_types(_log(spark, folder), [1, 3]).select("id", "type")


def _cases():
    return (
        filters.outcome(F.col("id") % 2 == 0, F.when(F.col("id") % 7 == 0, "seven")),
        filters.outcome(F.col("id") % 3 == 0, F.when(F.col("id") % 11 == 0, "eleven")),
        filters.outcome(F.col("id") % 5 == 0),
    )


_CASE_SQL = f"{LOG}, c AS (SELECT id, id % 2 = 0 AS a, CASE WHEN id % 7 = 0 THEN 'seven' END AS ae, id % 3 = 0 AS b, CASE WHEN id % 11 = 0 THEN 'eleven' END AS be, id % 5 = 0 AS d FROM log)"


@query(f"WITH {_CASE_SQL} SELECT id, CASE WHEN NOT a OR ae IS NOT NULL THEN a WHEN NOT b OR be IS NOT NULL THEN b ELSE d END AS ok, CASE WHEN NOT a OR ae IS NOT NULL THEN ae WHEN NOT b OR be IS NOT NULL THEN be END AS err FROM c")
def filter_all(spark, folder):
    return _log(spark, folder).select("id", filters.all_filters(*_cases()).alias("o")).select("id", "o.ok", "o.err")


@query(f"WITH {_CASE_SQL} SELECT id, (a AND ae IS NULL) OR (b AND be IS NULL) OR d AS ok, CASE WHEN (a AND ae IS NULL) OR (b AND be IS NULL) OR d THEN NULL ELSE coalesce(be, ae) END AS err FROM c")
def filter_any(spark, folder):
    return _log(spark, folder).select("id", filters.any_filters(*_cases()).alias("o")).select("id", "o.ok", "o.err")


@query(f"WITH {LOG} SELECT id, CAST(metadata->>'k' AS BIGINT) AS k FROM log WHERE CAST(metadata->>'k' AS BIGINT) > 50")
def filter_metadata(spark, folder):
    ok = filters.metadata_filter("k bigint", lambda m: m["k"] > 50)
    rows = _log(spark, folder).where(ok["ok"])
    return rows.select("id", F.from_json(F.col("metadata").cast("string"), "k bigint")["k"].alias("k"))


@query(f"WITH {LOG} SELECT CASE WHEN type NOT IN (1, 2, 3) THEN 'skipped' WHEN id % 101 = 0 THEN 'failed' WHEN id % 2 = 1 THEN 'skipped' ELSE 'processed' END AS outcome, count(*) AS n FROM log GROUP BY 1")
def consumer_outcomes(spark, folder):
    keep = filters.outcome(F.col("id") % 2 == 0, F.when(F.col("id") % 101 == 0, "bad"))
    return _log(spark, folder).groupBy(filters.consumer_outcome([1, 2, 3], keep).alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT l.id, c.c_name, c.c_mktsegment FROM log l LEFT JOIN customer c ON l.foreign_id = CAST(c.c_custkey AS VARCHAR)")
def entity_lookup(spark, folder):
    """Events point to entities; a lookup joins them. The optimizer picks the join by size."""
    customer = tables.parquet(spark, folder, "customer").select(F.col("c_custkey").cast("string").alias("key"), "c_name", "c_mktsegment")
    return _log(spark, folder).select("id", "foreign_id").join(customer, F.col("foreign_id") == F.col("key"), "left").select("id", "c_name", "c_mktsegment")


# Shards.


def _shard_sql(key: str, n: int) -> str:
    return f"({FNV.format(k=key)} % {n} + 1)::INT"


@query(f"WITH {LOG} SELECT id, {_shard_sql('CAST(id AS VARCHAR)', 10)} AS shard FROM log")
def shard_by_id(spark, folder):
    return shards.with_shards(_log(spark, folder), 10).select("id", "shard")


@query(f"WITH {LOG} SELECT type, {_shard_sql('CAST(type AS VARCHAR)', 3)} AS shard, count(*) AS n FROM log GROUP BY ALL")
def shard_by_type(spark, folder):
    return shards.with_shards(_log(spark, folder), 3, shards.BY_TYPE).groupBy("type", "shard").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT foreign_id, {_shard_sql('foreign_id', 4)} AS shard, count(*) AS n FROM log GROUP BY ALL")
def shard_by_foreign_id(spark, folder):
    # One hash for each entity: events are counted first.
    counted = _log(spark, folder).groupBy("foreign_id").agg(F.count(F.lit(1)).alias("n"))
    return shards.with_shards(counted, 4, shards.BY_FOREIGN_ID).select("foreign_id", "shard", "n")


@query(f"WITH {LOG} SELECT id, {_shard_sql('metadata', 5)} AS shard FROM log")
def shard_by_custom_key(spark, folder):
    return shards.with_shards(_log(spark, folder), 5, F.col("metadata").cast("string")).select("id", "shard")


@query(f"WITH {LOG} SELECT {_shard_sql('CAST(id AS VARCHAR)', 10)} AS shard, count(*) AS n FROM log GROUP BY 1")
def shard_balance(spark, folder):
    return shards.with_shards(_log(spark, folder), 10).groupBy("shard").agg(F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG} SELECT 'mine_' || {_shard_sql('foreign_id', 10)} || '_of_10' AS name, count(*) AS n, max(id) AS cursor FROM log GROUP BY 1")
def shard_names(spark, folder):
    """The consumers of the log's shards by entity, with what each would have consumed."""
    rows = shards.with_shards(_log(spark, folder), 10, shards.BY_FOREIGN_ID)
    return rows.groupBy(shards.shard_name(F.lit("mine"), F.col("shard"), 10).alias("name")).agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("cursor"))


# Cursors: every user's events set the user's cursor, in an order that is shuffled a little.


def _sets(spark, folder) -> DataFrame:
    return _log(spark, folder).select(F.concat(F.lit("c"), F.col("foreign_id")).alias("consumer"), F.col("id").alias("seq"), (F.col("id") + (F.col("id") * 37) % 23).cast("string").alias("cursor"))


_SETS = f"{LOG}, sets AS (SELECT 'c' || foreign_id AS consumer, id AS seq, CAST(id + (id * 37) % 23 AS VARCHAR) AS cursor FROM log)"


def _monotone_sql(kind: str) -> str:
    return f"WITH {_SETS} SELECT consumer, seq, cursor, coalesce(CAST(cursor AS {kind}) > max(CAST(cursor AS {kind})) OVER (PARTITION BY consumer ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM sets"


@query(_monotone_sql("BIGINT"))
def cursor_monotone_int(spark, folder):
    return cursors.monotone(_sets(spark, folder))


@query(_monotone_sql("VARCHAR"))
def cursor_monotone_string(spark, folder):
    return cursors.monotone(_sets(spark, folder), strings=True)


@query(f"WITH {_SETS} SELECT consumer, CAST(max(CAST(cursor AS BIGINT)) AS VARCHAR) AS cursor FROM sets GROUP BY 1")
def cursor_final(spark, folder):
    return cursors.final(_sets(spark, folder))


@query(f"WITH {_SETS}, f AS (SELECT consumer, seq // 100 AS flush, arg_max(cursor, seq) AS cursor FROM sets GROUP BY 1, 2) SELECT consumer, flush, cursor, coalesce(CAST(cursor AS BIGINT) > max(CAST(cursor AS BIGINT)) OVER (PARTITION BY consumer ORDER BY flush ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), true) AS accepted FROM f")
def cursor_async_flush(spark, folder):
    return cursors.flushed(_sets(spark, folder), F.floor(F.col("seq") / 100).cast("bigint"))


@query(f"WITH {_SETS} SELECT consumer, arg_max(cursor, seq) AS cursor FROM sets GROUP BY 1")
def cursor_memory(spark, folder):
    return cursors.overwritten(_sets(spark, folder))


@query(f"WITH {_SETS}, f AS (SELECT consumer, CAST(max(CAST(cursor AS BIGINT)) AS VARCHAR) AS cursor, min(seq) AS s FROM sets GROUP BY 1), p AS (SELECT consumer, CASE WHEN s % 3 = 0 THEN '' ELSE cursor END AS cursor FROM f WHERE s % 5 <> 0), b AS (SELECT consumer, cursor FROM f WHERE s % 7 <> 0) SELECT consumer, coalesce(nullif(p.cursor, ''), nullif(b.cursor, ''), '') AS cursor, nullif(p.cursor, '') IS NULL AND nullif(b.cursor, '') IS NOT NULL AS copied FROM p FULL JOIN b USING (consumer)")
def cursor_read_through(spark, folder):
    every = _sets(spark, folder).groupBy("consumer").agg(F.max(F.col("cursor").cast("bigint")).cast("string").alias("cursor"), F.min("seq").alias("s"))
    primary = every.where("s % 5 <> 0").select("consumer", F.when(F.col("s") % 3 == 0, "").otherwise(F.col("cursor")).alias("cursor"))
    return cursors.read_through(primary, every.where("s % 7 <> 0").select("consumer", "cursor"))


# Consumption patterns.


@query(f"WITH {LOG}, {HOLES}, n AS (SELECT id, row_number() OVER (ORDER BY id) AS pos FROM holes) SELECT pos // 7 AS seq, id AS cursor FROM n WHERE pos % 7 = 0")
def ack_every_n(spark, folder):
    return progress.ack_every(_holes(spark, folder), 7)


@query(f"WITH {LOG}, {HOLES}, n AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 64 AS batch FROM holes) SELECT batch, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM n GROUP BY 1 HAVING count(*) = 64")
def batch_by_count(spark, folder):
    return batching.by_count(_holes(spark, folder), 64)


def _fold_sql(length: int, hours: int) -> str:
    by_length = f"(SELECT min(id) FROM log WHERE id >= b.first_id + {length})" if length else "NULL"
    by_time = f"(SELECT min(id) FROM log WHERE ts >= b.start + INTERVAL {hours} HOUR AND id > b.first_id)" if hours else "NULL"
    nxt = f"least(coalesce({by_length}, 9223372036854775807), coalesce({by_time}, 9223372036854775807))"
    return f"""WITH RECURSIVE {LOG}, b AS (
 SELECT 0::BIGINT AS batch, min(id)::BIGINT AS first_id, min(ts) AS start FROM log
 UNION ALL SELECT b.batch + 1, l.id, l.ts FROM b JOIN log l ON l.id = {nxt}),
 r AS (SELECT batch, first_id, coalesce(lead(first_id) OVER (ORDER BY batch), (SELECT max(id) + 1 FROM log)) AS stop FROM b)
 SELECT 0::BIGINT AS part, batch, first_id, stop - 1 AS last_id, stop - first_id AS n FROM r"""


@query(_fold_sql(0, 6))
def batch_by_period(spark, folder):
    return batching.fold(_log(spark, folder), period_micros=6 * 3600 * 1_000_000)


@query(_fold_sql(84, 6))
def batch_by_both(spark, folder):
    return batching.fold(_log(spark, folder), length=84, period_micros=6 * 3600 * 1_000_000)


_DONE = f"{LOG}, k AS (SELECT id, (id + (id * 37) % 23) * 100 + (id * 37) % 23 AS moment FROM log), done AS (SELECT id, row_number() OVER (ORDER BY moment) AS done_pos FROM k)"


@query(f"WITH {_DONE}, r AS (SELECT id, max(done_pos) OVER (ORDER BY id) AS ready FROM done), s AS (SELECT ready, max(id) AS top FROM r GROUP BY 1) SELECT done_pos, max(coalesce(top, 0)) OVER (ORDER BY done_pos) AS watermark FROM done LEFT JOIN s ON ready = done_pos")
def completion_watermark(spark, folder):
    late = (F.col("id") * 37) % 23
    done = _log(spark, folder).select("id", ((F.col("id") + late) * 100 + late).alias("at"))
    return progress.watermark(with_position(done, "at", "done_pos"))


_FAILS = "(id * 31) % 6"


@query(f"WITH {LOG} SELECT id, least({_FAILS}, 3) + 1 AS attempts, least({_FAILS}, 3) AS returned, {_FAILS} > 3 AS ignored FROM log")
def best_effort_outcomes(spark, folder):
    """A consumer that fails on an event a number of times, run on the log with three retries."""
    done = patterns.in_tasks(_log(spark, folder).select("id"), _failing(), retries=3)
    return done.select("id", F.col("tries").alias("attempts"), (F.col("tries") - 1).alias("returned"), F.col("error").isNotNull().alias("ignored"))


def _failing() -> Callable[[dict], None]:
    tried: dict[int, int] = {}

    def handle(row: dict) -> None:
        i = row["id"]
        tried[i] = tried.get(i, 0) + 1
        if tried[i] <= (i * 31) % 6:
            raise ValueError(i)
        del tried[i]

    return handle


def _dead_letter_calls(spark, folder) -> DataFrame:
    """Two rounds over the events whose retries run out; the second meets rows that exist."""
    bad = retries.dead_letters(_log(spark, folder), F.expr(_FAILS), 3, F.col("type") == 2)
    rounds = bad.withColumn("round", F.explode(F.array(F.lit(0), F.lit(1))))
    return rounds.select((F.col("id") * 2 + F.col("round")).alias("seq"), F.concat(F.lit("consumer_"), F.col("type").cast("string")).alias("consumer"), F.col("id").alias("event_id"), F.concat(F.lit("failure "), F.col("round").cast("string")).alias("error_msg"), F.col("timestamp").alias("at"))


_CALLS = f"{LOG}, calls AS (SELECT id * 2 + r AS seq, 'consumer_' || type AS consumer, id AS event_id, 'failure ' || r AS error_msg, ts AS moment FROM log, (VALUES (0), (1)) v(r) WHERE {_FAILS} > 3 AND type <> 2), rec AS (SELECT row_number() OVER (ORDER BY seq) AS id, * EXCLUDE (k) FROM (SELECT *, row_number() OVER (PARTITION BY consumer, event_id ORDER BY seq) AS k FROM calls) WHERE k = 1)"


@query(f"WITH {_CALLS} SELECT id, consumer, CAST(event_id AS VARCHAR) AS event_id, error_msg, moment AS created, 1 AS error_status FROM rec")
def dead_letter_rows(spark, folder):
    return retries.recorded(_dead_letter_calls(spark, folder)).select("id", "consumer", "event_id", "error_msg", F.col("created_at").cast("timestamp_ntz").alias("created"), "error_status")


@query(f"WITH {_CALLS} SELECT row_number() OVER (ORDER BY c.seq) AS id, 1 AS type, CAST(r.id AS VARCHAR) AS foreign_id, c.consumer AS metadata FROM calls c JOIN rec r ON c.consumer = r.consumer AND c.event_id = r.event_id")
def dead_letter_events(spark, folder):
    calls = _dead_letter_calls(spark, folder)
    return retries.error_events(calls, retries.recorded(calls)).select("id", "type", "foreign_id", F.col("metadata").cast("string").alias("metadata"))


@query(f"WITH {LOG}, h AS (SELECT max(id) AS head FROM log), c AS (SELECT 'c' || foreign_id AS consumer, CASE WHEN min(id) % 2 = 0 THEN '' ELSE CAST(max(id) AS VARCHAR) END AS cursor FROM log GROUP BY 1) SELECT consumer, CASE WHEN cursor = '' THEN head ELSE CAST(cursor AS BIGINT) END AS after, cursor = '' AS from_head FROM c, h")
def bootstrap_start(spark, folder):
    events = _log(spark, folder)
    stored = events.groupBy(F.concat(F.lit("c"), F.col("foreign_id")).alias("consumer")).agg(F.when(F.min("id") % 2 == 0, "").otherwise(F.max("id").cast("string")).alias("cursor"))
    return waiting.bootstrap(stored, log.head(events))


@query(f"WITH {LOG} SELECT id, type, foreign_id FROM log WHERE id > 100 AND foreign_id = '7' AND type IN (3, 5) ORDER BY id LIMIT 1")
def await_match(spark, folder):
    return waiting.awaited(_log(spark, folder), 100, "7", [3, 5]).select("id", "type", "foreign_id")


@query(f"WITH {LOG}, n AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 250 AS page FROM log) SELECT page, min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM n GROUP BY 1")
def poll_pages(spark, folder):
    """The events as a paged API, polled to its end: what the stream gave of each page."""
    place, out = _place(spark, "poll"), _place(spark, "polled")
    polling.write_ids(_log(spark, folder), f"{place}/ids")
    rows = polling.live(spark, polling.TablePages(f"{place}/ids", 250), f"{place}/journal", pages=500, backoff=3600)
    query = rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{place}/checkpoint").trigger(processingTime="0 seconds").start()
    try:
        query.processAllAvailable()
    finally:
        query.stop()
    seen = spark.read.schema(polling.SCHEMA).parquet(out)
    return seen.groupBy(F.col("page").cast("bigint").alias("page")).agg(F.min(F.col("id").cast("bigint")).alias("first_id"), F.max(F.col("id").cast("bigint")).alias("last_id"), F.count(F.lit(1)).alias("n"))


# Inserts.


@query(f"WITH {LOG}, h AS (SELECT max(id) AS head FROM log), o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS k, o_custkey FROM orders) SELECT k + head AS id, 3 AS type, CAST(o_custkey AS VARCHAR) AS foreign_id FROM o, h")
def insert_events(spark, folder):
    """The orders as new events behind the head."""
    rows = tables.parquet(spark, folder, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("foreign_id"), F.lit(3).alias("type"))
    head = log.head_id(_log(spark, folder))
    return log.new_events(spark, rows, head, now=_now()).select("id", "type", "foreign_id")


# Stored tables: written to the shared folder, and read again.


def _place(spark, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@query("WITH o AS (SELECT row_number() OVER (ORDER BY o_orderkey) AS id, o_custkey FROM orders), n AS (SELECT count(*) AS n FROM o), c AS (SELECT row_number() OVER (ORDER BY c_custkey) AS k, c_nationkey FROM customer) SELECT id, 3 AS type, CAST(o_custkey AS VARCHAR) AS foreign_id, NULL AS metadata FROM o UNION ALL SELECT k + n, 4, CAST(c_nationkey AS VARCHAR), 'customer' FROM c, n")
def log_append(spark, folder):
    """Orders, then customers, appended to a log in two batches."""
    stored = StoredLog(spark, _place(spark, "log"))
    stored.append(tables.parquet(spark, folder, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("foreign_id"), F.lit(3).alias("type")))
    stored.append(tables.parquet(spark, folder, "customer").select(F.col("c_custkey").alias("seq"), F.col("c_nationkey").alias("foreign_id"), F.lit(4).alias("type"), F.encode(F.lit("customer"), "UTF-8").alias("metadata")))
    return stored.events().select("id", "type", "foreign_id", F.col("metadata").cast("string").alias("metadata"))


@query(f"WITH {LOG}, {HOLES}, m AS (SELECT max(id) AS top FROM holes) SELECT id, type, foreign_id FROM holes UNION ALL SELECT id, 0, '0' FROM log, m WHERE (id - 1) % 997 = 996 AND id < top")
def gap_fill_log(spark, folder):
    """Holes closed in the log itself by the listener's filler."""
    stored = StoredLog(spark, _place(spark, "log"))
    append_parquet(stored.columns.write(_holes(spark, folder)), stored.path)
    fill_gaps(stored).poll()
    return stored.events().select("id", "type", "foreign_id")


@query(f"WITH {LOG} SELECT 'c' || type AS id, CAST(max(id) AS VARCHAR) AS last_event_id FROM log GROUP BY 1")
def cursor_table(spark, folder):
    """A consumer a type: its cursor is set twice, and read by another store of the same table."""
    url = _place(spark, "cursors")
    store = cursors.TableCursors(spark, url, buffered=False)
    # One row a type.
    for row in _log(spark, folder).groupBy("type").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).collect():
        for c in sorted({row["lo"], row["hi"]}):
            store.set(f"c{row['type']}", str(c))
    return cursors.TableCursors(spark, url).table().select("id", "last_event_id")


def _calls(spark, folder) -> DataFrame:
    rows = _log(spark, folder)
    return rows.select(F.col("id").alias("seq"), F.concat(F.lit("c"), F.col("id") % 3).alias("consumer"), F.col("foreign_id").alias("event_id"), F.concat(F.lit("e"), "id").alias("error_msg"), F.col("timestamp").alias("at"))


@query(f"WITH {LOG}, c AS (SELECT id, 'c' || (id % 3) AS consumer, foreign_id AS event_id FROM log) SELECT consumer, event_id, 'e' || min(id) AS error_msg, 1 AS error_status, count(*) AS events FROM c GROUP BY 1, 2")
def error_store(spark, folder):
    """Failed calls in two batches: those of the second that exist stay as they are; an event a call."""
    store, calls = ErrorStore(spark, _place(spark, "errors")), _calls(spark, folder)
    middle = calls.agg(F.expr("percentile(seq, 0.5)")).first()[0] or 0
    store.record(calls.where(F.col("seq") <= middle))
    store.record(calls.where(F.col("seq") > middle))
    events = store.events.events().groupBy("foreign_id").agg(F.count(F.lit(1)).alias("events"))
    rows = store.errors()
    return rows.join(events, rows["id"].cast("string") == events["foreign_id"]).select("consumer", "event_id", "error_msg", "error_status", "events")


@query(f"WITH {LOG}, {NOOPS} SELECT id, type, foreign_id FROM noops WHERE NOT (foreign_id = '0' AND type = 0)")
def live_to_head(spark, folder):
    """The streaming source and the run loop: a stored log drained to its head in bounded batches."""
    path, out = _place(spark, "log"), _place(spark, "seen")
    _noops(spark, folder).write.parquet(path)
    held = cursors.TableCursors(spark, _place(spark, "cursors"))
    consumer = Consumer("live", lambda batch, _: append_parquet(batch.select("id", "type", "foreign_id"), out))
    run(spark, Spec(path, held, consumer, StreamOptions(to_head=True)), _place(spark, "checkpoint"))
    return spark.read.schema("id long, type int, foreign_id string").parquet(out)


def _stored(spark, folder) -> str:
    path = _place(spark, "log")
    _noops(spark, folder).write.parquet(path)
    return path


@query(f"WITH {LOG}, {NOOPS}, k AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 64 AS g FROM noops WHERE type IN (1, 3)), b AS (SELECT min(id) AS first_id, max(id) AS last_id, count(*) AS n FROM k GROUP BY g) SELECT first_id, last_id, n FROM b WHERE n = 64")
def live_batches(spark, folder):
    """Batches of events of two types from a live log, as the engine's state cuts them."""
    held, out = cursors.TableCursors(spark, _place(spark, "cursors")), _place(spark, "batches")
    consumer = patterns.BatchConsumer("batches", lambda rows: append_parquet(rows.select("batch", "id"), out), types=[1, 3], cursors=held, length=64, together=True)
    run(spark, Spec(_stored(spark, folder), held, consumer, StreamOptions(to_head=True)), _place(spark, "checkpoint"))
    return spark.read.schema("batch long, id long").parquet(out).groupBy(F.col("batch").alias("first_id")).agg(F.max("id").alias("last_id"), F.count(F.lit(1)).alias("n"))


@query(f"WITH {LOG}, {NOOPS}, s AS (SELECT id, foreign_id, type, {_shard_sql('CAST(id AS VARCHAR)', 4)} AS shard FROM noops), c AS (SELECT max(id) AS cursor FROM log) SELECT 'fleet_' || shard || '_of_4' AS name, count(*) AS n, min(id) AS first_id, max(id) AS last_id, CAST(any_value(cursor) AS VARCHAR) AS cursor FROM s, c WHERE NOT (foreign_id = '0' AND type = 0) GROUP BY 1")
def live_shards(spark, folder):
    """The consumers of four shards over one scan of a live log, with their cursors after it."""
    held, out = cursors.TableCursors(spark, _place(spark, "cursors")), _place(spark, "shards")
    path = _stored(spark, folder)

    def member(m: int, name: str) -> Consumer:
        # Side by side, so each to a folder of its own.
        return Consumer(name, lambda batch, _: append_parquet(batch.select("id"), f"{out}/name={name}"))

    run(spark, patterns.parallel(Spec(path, held, Consumer("fleet", None), StreamOptions(to_head=True)), 4, member), _place(spark, "checkpoint"))
    # One row a shard.
    at = spark.createDataFrame([(n, held.get(n)) for n in shards.shard_names("fleet", 4)], "name string, cursor string")
    seen = spark.read.schema("id long, name string").parquet(out).groupBy("name").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"), F.max("id").alias("last_id"))
    return seen.join(at, "name")


@query(f"WITH {LOG}, {NOOPS}, n AS (SELECT type, count(*) AS n, max(id) AS last_id FROM noops WHERE NOT (foreign_id = '0' AND type = 0) GROUP BY 1) SELECT name, type, n, last_id, 1 AS loads FROM n, (VALUES ('first'), ('second')) v(name)")
def live_cached(spark, folder):
    """Two consumers of one log that share its tail: what each saw by type, and how often the log was loaded."""
    stored, out = StoredLog(spark, _stored(spark, folder)), _place(spark, "cached")
    held, cache = cursors.TableCursors(spark, _place(spark, "cursors")), TailCache(stored.events)
    try:
        for name in ("first", "second"):
            consumer = Consumer(name, lambda batch, _, name=name: append_parquet(batch.select(F.lit(name).alias("name"), "type", "id"), out))
            run(spark, Spec(stored.path, held, consumer, StreamOptions(to_head=True), cache=cache), _place(spark, "checkpoint"))
    finally:
        cache.close()
    seen = spark.read.schema("name string, type int, id long").parquet(out).groupBy("name", "type").agg(F.count(F.lit(1)).alias("n"), F.max("id").alias("last_id"))
    return seen.withColumn("loads", F.lit(cache.misses))


# Blob cursors: a blob a day.


def _blob_ids(spark, folder) -> DataFrame:
    from pyspark.sql import Window

    rows = _log(spark, folder).select("id", F.date_format("timestamp", "yyyy/MM/dd").alias("key"))
    by_day = Window.partitionBy("key")
    offset = F.row_number().over(by_day.orderBy("id")) - 1
    rows = rows.withColumns({"offset": offset.cast("bigint"), "n": F.count(F.lit(1)).over(by_day)})
    return rows.select("id", "key", "offset", blobs.render(F.col("key"), F.col("offset"), F.col("offset") == F.col("n") - 1).alias("cursor"))


_BLOBS = f"{LOG}, o AS (SELECT id, strftime(ts, '%Y/%m/%d') AS key, row_number() OVER (PARTITION BY strftime(ts, '%Y/%m/%d') ORDER BY id) - 1 AS offset_, count(*) OVER (PARTITION BY strftime(ts, '%Y/%m/%d')) AS n FROM log), b AS (SELECT id, key, offset_, CASE WHEN offset_ = n - 1 THEN key || '|eof' ELSE key || '|' || lpad(CAST(length(CAST(offset_ AS VARCHAR)) AS VARCHAR), 2, '0') || '|' || offset_ END AS cursor FROM o)"


@query(f"WITH {_BLOBS} SELECT id, cursor FROM b")
def blob_ids(spark, folder):
    return _blob_ids(spark, folder).select("id", "cursor")


@query(f"WITH {_BLOBS} SELECT id, key AS day FROM b WHERE key > '2024/01/02' OR key = '2024/01/02' AND offset_ > 5")
def blob_resume(spark, folder):
    """A blob of JSON records for each day, read on from the sixth record of the second of January."""
    url = _place(spark, "blobs")
    rows = _log(spark, folder).select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "id", F.to_json(F.struct("id", "foreign_id")).alias("value"))
    rows.repartition("day").sortWithinPartitions("day", "id").select("day", "value").write.partitionBy("day").text(url)
    bucket = Bucket(url, "day=")
    # One key a day.
    key = next((k for k in bucket.keys("day=2024-01-02/") if k.startswith("day=2024-01-02/")), None)
    events = bucket.stream(spark, f"{key}|01|5" if key else "")
    record = F.from_json(F.col("metadata").cast("string"), "id long, foreign_id string")
    return events.select(record["id"].alias("id"), F.translate(F.substring("id", 5, 10), "-", "/").alias("day"))


@query(f"WITH {_BLOBS} SELECT id, key AS day FROM b")
def blob_follow(spark, folder):
    """A blob for each day, followed from the start in micro-batches of ten blobs."""
    url, out = _place(spark, "blobs"), _place(spark, "followed")
    rows = _log(spark, folder).select(F.date_format("timestamp", "yyyy-MM-dd").alias("day"), "id", F.to_json(F.struct("id", "foreign_id")).alias("value"))
    rows.repartition("day").sortWithinPartitions("day", "id").select("day", "value").write.partitionBy("day").text(url)
    store = cursors.TableCursors(spark, _place(spark, "cursors"), rank=blobs.rank_of)
    Bucket(url, "day=").follow(spark, lambda batch: append_parquet(batch.select("id", "metadata"), out), store, "mine", rounds=1, maxBlobs="10")
    record = F.from_json(F.col("metadata").cast("string"), "id long, foreign_id string")
    seen = spark.read.schema("id string, metadata binary").parquet(out)
    return seen.select(record["id"].alias("id"), F.translate(F.substring("id", 5, 10), "-", "/").alias("day"))


@query(f"WITH {_BLOBS} SELECT id, key, CASE WHEN offset_ = n_1 THEN NULL ELSE offset_ END AS offset_, offset_ = n_1 AS eof FROM (SELECT b.*, max(offset_) OVER (PARTITION BY key) AS n_1 FROM b)")
def blob_cursor_parse(spark, folder):
    rows = _blob_ids(spark, folder).select("id", blobs.parse(F.col("cursor")).alias("c"))
    return rows.select("id", "c.key", F.col("c.offset").alias("offset_"), "c.eof")


# Health.


def _consumed(spark, folder) -> DataFrame:
    keep = filters.outcome(F.col("id") % 2 == 0, F.when(F.col("id") % 101 == 0, "bad"))
    return _log(spark, folder).select(F.concat(F.lit("c"), F.col("foreign_id")).alias("consumer"), "id", "timestamp", filters.consumer_outcome([1, 2, 3], keep).alias("outcome"))


_CONSUMED = f"{LOG}, used AS (SELECT 'c' || foreign_id AS consumer, id, ts, CASE WHEN type NOT IN (1, 2, 3) THEN 'skipped' WHEN id % 101 = 0 THEN 'failed' WHEN id % 2 = 1 THEN 'skipped' ELSE 'processed' END AS outcome FROM log)"
_LATE = "2024-02-05 00:00:00"
_LAG = f"(epoch_us(TIMESTAMP '{_LATE}') - epoch_us(max(ts))) / 1e6"


@query(f"WITH {_CONSUMED} SELECT consumer, count(*) AS events, max(id) AS cursor, count(*) FILTER (WHERE outcome = 'skipped') AS skipped, count(*) FILTER (WHERE outcome = 'failed') AS errors, round({_LAG}, 3) AS lag_seconds, ({_LAG} > 1800)::INT AS lag_alert, ({_LAG} < 86400)::INT AS active FROM used GROUP BY 1")
def consumer_health(spark, folder):
    return health.consumer_health(_consumed(spark, folder), F.lit(_LATE).cast("timestamp"))


_LE = ", ".join(f"({float(b)!r}::DOUBLE)" for b in health.AGE_BUCKETS) + ", ('infinity'::DOUBLE)"


@query(f"WITH {LOG} SELECT type, CASE WHEN le = 'infinity'::DOUBLE THEN -1 ELSE le END AS le, count(*) FILTER (WHERE (epoch_us(TIMESTAMP '{_LATE}') - epoch_us(ts)) / 1e6 <= le) AS n FROM log, (VALUES {_LE}) v(le) GROUP BY 1, 2")
def age_histogram(spark, folder):
    age = ages.age_seconds(F.col("timestamp"), F.lit(_LATE))
    out = health.histogram(_log(spark, folder).select("type", age.alias("age")), F.col("age"), health.AGE_BUCKETS, "type")
    return out.withColumn("le", F.when(F.col("le") == float("inf"), -1.0).otherwise(F.col("le")))


@query(f"WITH {LOG}, g AS (SELECT foreign_id, max(ts) AS last FROM log GROUP BY 1) SELECT foreign_id, ((epoch_us(TIMESTAMP '{_LATE}') - epoch_us(last)) / 1e6 < 432000)::INT AS active FROM g")
def activity_gauge(spark, folder):
    last = _log(spark, folder).groupBy("foreign_id").agg(F.max("timestamp").alias("last"))
    return last.select("foreign_id", health.active(F.col("last"), F.lit(_LATE), 5 * 86400).alias("active"))


# Scalar functions.

_TEXTS = "CASE id % 7 WHEN 0 THEN CAST(id AS VARCHAR) WHEN 1 THEN '-' || id WHEN 2 THEN '+' || id WHEN 3 THEN ' ' || id WHEN 4 THEN '99999999999999999999' || id WHEN 5 THEN 'x' || id ELSE '-99999999999999999999' END"


@query(f"""WITH {LOG}, t AS (SELECT id, {_TEXTS} AS s FROM log) SELECT id,
 CASE WHEN NOT regexp_full_match(s, '[+-]?[0-9]+') THEN 0 ELSE coalesce(TRY_CAST(s AS BIGINT), CASE WHEN s[1] = '-' THEN -9223372036854775808 ELSE 9223372036854775807 END) END::BIGINT AS n,
 regexp_full_match(s, '[+-]?[0-9]+') AND TRY_CAST(s AS BIGINT) IS NOT NULL AS is_int FROM t""")
def id_parse(spark, folder):
    text = F.expr(_TEXTS.replace("VARCHAR", "STRING"))
    return _log(spark, folder).select("id", text.alias("s")).select("id", ids.to_int(F.col("s")).alias("n"), ids.is_int(F.col("s")).alias("is_int"))


@query(f"WITH {LOG}, t AS (SELECT id, lpad(format('{{:x}}', id), 32, '0') AS t, lpad(format('{{:x}}', id % 1000), 16, '0') AS s FROM log) SELECT id, CASE WHEN id % 1000 = 0 THEN NULL ELSE '0A20' || hex(encode(t)) || '1210' || hex(encode(s)) END AS raw, CASE WHEN id % 1000 = 0 THEN NULL ELSE t END AS trace_id, CASE WHEN id % 1000 = 0 THEN NULL ELSE s END AS span_id FROM t")
def trace_codec(spark, folder):
    hexed = lambda n, width: F.lpad(F.lower(F.hex(n)), width, "0")
    rows = _log(spark, folder).select("id", hexed(F.col("id"), 32).alias("t"), hexed(F.col("id") % 1000, 16).alias("s"))
    rows = rows.select("id", traces.marshal(F.col("t"), F.col("s")).alias("m"))
    return rows.select("id", F.hex("m").alias("raw"), traces.unmarshal(F.col("m")).alias("u")).select("id", "raw", "u.trace_id", "u.span_id")
