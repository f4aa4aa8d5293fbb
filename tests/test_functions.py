"""Identifiers, hashes, cursors, traces and wire codecs, with golden values."""

from datetime import datetime, timedelta, timezone

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from logweir.functions import blobs, ids, traces, wire
from logweir.operators import shards
from logweir.options import StreamOptions


def one(spark, *columns):
    return tuple(spark.range(1).select(*[c.alias(f"c{i}") for i, c in enumerate(columns)]).first())


@pytest.mark.parametrize(
    "text, number, ok",
    [("12", 12, True), ("-3", -3, True), ("+7", 7, True), (" 7", 0, False), ("x", 0, False), ("", 0, False), ("99999999999999999999", 2**63 - 1, False), ("-99999999999999999999", -(2**63), False), (None, 0, False)],
)
def test_int_ids(spark, text, number, ok):
    c = F.lit(text).cast("string")
    assert one(spark, ids.to_int(c), ids.is_int(c)) == (number, ok)


@pytest.mark.parametrize("text, value", [("1", 84696366), ("Hello, World", 1472297245), ("", 2166136261)])
def test_hash(spark, text, value):
    assert one(spark, ids.fnv1_32(F.lit(text))) == (value,)


@pytest.mark.parametrize(
    "n, expected",
    [
        (3, {"1": 1, "2": 3, "3": 2, "4": 1, "5": 3, "100": 1, "200": 2, "300": 2, "Hello, World": 2}),
        (4, {"0": 4, "1": 3, "2": 2, "3": 1, "2304": 1, "124566": 2, "140054": 2, "123412455": 3, "2342": 3, "123": 4}),
    ],
)
def test_shards(spark, n, expected):
    frame = spark.createDataFrame([(k,) for k in expected], "k string").select("k", shards.shard(n, "k").alias("s"))
    assert {r["k"]: r["s"] for r in frame.collect()} == expected


def test_shard_balance_and_names(spark):
    counts = spark.range(1, 1001).groupBy(shards.shard(10).alias("s")).count().collect()
    assert len(counts) == 10 and all(90 < r["count"] < 110 for r in counts)
    assert shards.shard_names("test", 10)[0] == "test_1_of_10" and shards.shard_names("a", 2, lambda b, m, n: f"{b}{m}/{n}") == ["a0/2", "a1/2"]
    assert [r["name"] for r in shards.names_table(spark, "test", 2).orderBy("shard").collect()] == ["test_1_of_2", "test_2_of_2"]


def test_every_event_has_one_shard(spark):
    parted = shards.parallel(spark.range(1, 101), 4)
    assert parted.count() == 100 and parted.rdd.getNumPartitions() == 4


def test_blob_cursors(spark):
    order = ["path/to/file|01|0", "path/to/file|01|9", "path/to/file|02|10", "path/to/file|03|999", "path/to/file|eof"]
    made = [one(spark, blobs.render(F.lit("path/to/file"), F.lit(n), F.lit(False)))[0] for n in (0, 9, 10, 999)]
    assert [*made, one(spark, blobs.render(F.lit("path/to/file"), F.lit(0), F.lit(True)))[0]] == order == sorted(order)
    parse = lambda c: tuple(one(spark, blobs.parse(F.lit(c)))[0])
    assert parse("k|02|10") == ("k", 10, False, True)
    assert parse("k|3") == ("k", 3, False, True)
    assert parse("k|eof") == ("k", None, True, True)
    assert parse("")[3] and not parse("k")[3] and not parse("a|b|c|d")[3] and not parse("k|x")[3]


def test_traces(spark):
    t, s = f"{9:032x}", f"{2:016x}"
    raw = one(spark, traces.marshal(F.lit(t), F.lit(s)))[0]
    assert raw == b"\x0a\x20" + t.encode() + b"\x12\x10" + s.encode()
    assert tuple(one(spark, traces.unmarshal(F.lit(raw)))[0]) == (t, s)
    assert one(spark, traces.unmarshal(F.lit(b"rubbish")), traces.marshal(F.lit("0" * 32), F.lit(s))) == (None, None)


def test_options_wire():
    assert wire.options_to_wire(StreamOptions()) == b""
    o = StreamOptions(timedelta(seconds=90, microseconds=5), True, True)
    assert wire.options_from_wire(wire.options_to_wire(o)) == o
    assert wire.request_from_wire(wire.request_to_wire("17", o)) == ("17", o)
    assert StreamOptions.from_source_options(o.as_source_options()) == o and not StreamOptions().as_source_options()


@settings(max_examples=60, deadline=None)
@given(st.text(max_size=20), st.integers(-(2**31), 2**31 - 1), st.text(max_size=20), st.integers(-(10**15), 10**15), st.binary(max_size=30), st.binary(max_size=30))
def test_event_wire(i, kind, foreign, micros, metadata, trace):
    e = wire.WireEvent(i, kind, foreign, datetime(1970, 1, 1, tzinfo=timezone.utc) + timedelta(microseconds=micros), metadata, trace)
    assert wire.event_from_wire(wire.event_to_wire(e)) == e
