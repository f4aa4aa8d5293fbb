"""Every registered log query against its SQL, on the smallest tables."""

import ast
import inspect
import os

import duckdb
import pytest

from logweir.plans import catalog

FOLDER = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for file in os.listdir(FOLDER):
        con.execute(f"create view {file.removesuffix('.parquet')} as select * from '{FOLDER}/{file}'")
    return con


def rows(values, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(str(round(r[i], 9) if isinstance(r[i], float) else r[i]) for i in order) for r in values)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_sql(spark, duck, name):
    frame = catalog.queries()[name](spark, FOLDER)
    cursor = duck.execute(catalog.oracle_sql()[name])
    columns = [d[0] for d in cursor.description]
    assert sorted(frame.columns) == sorted(columns)
    assert rows(frame.collect(), frame.columns) == rows(cursor.fetchall(), columns)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
    assert set(catalog.queries()) <= set(__spark_entry__.queries())


def test_catalog_defines_each_name_once():
    names = [node.name for node in ast.parse(inspect.getsource(catalog)).body if isinstance(node, ast.FunctionDef)]
    assert sorted(names) == sorted(set(names))


@pytest.fixture
def twelve(spark, tmp_path):
    """Events 1 to 12: the retries of 4, 5, 10 and 11 run out; the error of 5 is expected."""
    kinds = {4: "click", 5: "error", 11: "view"}
    events = [(i - 1, i, kinds.get(i, "purchase"), "{}") for i in range(1, 13)]
    frame = spark.createDataFrame(events, "event_id long, user_id long, event_type string, props string")
    frame.selectExpr("*", "timestamp_ntz '2024-01-01 00:00:00' AS ts").write.parquet(str(tmp_path / "events.parquet"))
    return str(tmp_path)


def test_dead_letter_rows(spark, twelve):
    got = catalog.queries()["dead_letter_rows"](spark, twelve).orderBy("id").collect()
    assert [(r["id"], r["consumer"], r["event_id"], r["error_msg"], r["error_status"]) for r in got] == [
        (1, "consumer_1", "4", "failure 0", 1), (2, "consumer_3", "10", "failure 0", 1), (3, "consumer_5", "11", "failure 0", 1),
    ]


def test_dead_letter_events(spark, twelve):
    got = catalog.queries()["dead_letter_events"](spark, twelve).orderBy("id").collect()
    assert [(r["id"], r["type"], r["foreign_id"], r["metadata"]) for r in got] == [
        (1, 1, "1", "consumer_1"), (2, 1, "1", "consumer_1"), (3, 1, "2", "consumer_3"), (4, 1, "2", "consumer_3"), (5, 1, "3", "consumer_5"), (6, 1, "3", "consumer_5"),
    ]


def test_poll_pages_of_a_table_with_holes(spark, tmp_path):
    """Ids are missing inside pages, and more than a page of them at once."""
    spark.range(2000).where("(id % 997 != 996) AND (id < 300 OR id >= 900)").selectExpr("id AS event_id", "id AS user_id", "'view' AS event_type", "'{}' AS props", "timestamp_ntz '2024-01-01 00:00:00' AS ts", "1.0D AS value").write.parquet(str(tmp_path / "events.parquet"))
    got = catalog.queries()["poll_pages"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"create view events as select * from '{tmp_path}/events.parquet/*.parquet'")
    cursor = con.execute(catalog.oracle_sql()["poll_pages"])
    columns = [d[0] for d in cursor.description]
    assert rows(got.collect(), got.columns) == rows(cursor.fetchall(), columns)
