"""The relational store over JDBC, on an embedded database."""

import datetime as dt
import uuid

import pytest

from quarryspark import schemas
from quarryspark.sources.jdbc_store import JdbcStore, local_database


@pytest.fixture
def store(spark):
    return JdbcStore(spark, local_database(spark, f"t{uuid.uuid4().hex}"), connections=2, batch=7)


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_round_trip_of_all_types(spark, store):
    t = dt.datetime(2026, 5, 11, 12, 0, 0, 123456)
    rows = [(f"id-{k}", f"o'brien \"{k}\" é {'long ' * 9000 if k == 3 else ''}", k % 2 == 0, t + dt.timedelta(days=k), k, k / 3, None if k % 3 else k) for k in range(50)]
    frame = spark.createDataFrame(rows, 'id string, name string, `is "on"` boolean, created_at timestamp, n long, x double, m int').repartition(5)
    store.create("users", frame.schema, ["id"])
    store.append(frame, "users")
    assert plain(store.read("users")) == plain(frame)
    parts = store.read("users", "n", 4)
    assert parts.rdd.getNumPartitions() == 4 and plain(parts) == plain(frame)
    assert plain(store.read("users", "created_at", 3)) == plain(frame)


def test_the_tables_of_the_product(spark, store):
    for name in ("users", "refresh_tokens", "folders", "conversations", "messages"):
        store.create(name, schemas.TABLES[name], ["id"])
        assert store.read(name).count() == 0 and store.read(name).columns == spark.createDataFrame([], schemas.TABLES[name]).columns


def test_filters_and_columns_are_pushed(spark, store):
    frame = spark.createDataFrame([(k, f"r{k % 3}", f"text {k}") for k in range(40)], "n long, role string, text string")
    store.create("messages", frame.schema, ["n", "role"])
    store.append(frame, "messages")
    found = store.read("messages", "n", 4).where("role = 'r1' and n > 10").select("n")
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "EqualTo(role,r1)" in plan and "GreaterThan(n,10)" in plan and "text" not in plan.split("ReadSchema")[-1]
    assert sorted(r.n for r in found.collect()) == [n for n in range(11, 40) if n % 3 == 1]


def test_upserts_are_whole(spark, store):
    schema = "id string, turn long, text string"
    store.create("m", schema, ["id", "turn"])
    first = spark.createDataFrame([("a", k, f"t{k}") for k in range(20)], schema)
    assert store.upsert(first, "m", ["id", "turn"]) == 20
    second = spark.createDataFrame([("a", k, f"new {k}") for k in range(15, 25)], schema)
    for _ in range(2):
        assert store.upsert(second, "m", ["id", "turn"]) == 10
        assert {r.turn: r.text for r in store.read("m").collect()} == {k: f"t{k}" if k < 15 else f"new {k}" for k in range(25)}
    before = plain(store.read("m"))
    twice = spark.createDataFrame([("a", 1, "x"), ("a", 1, "y")], schema)
    with pytest.raises(Exception, match="(?i)duplicate|primary|unique"):
        store.upsert(twice, "m", ["id", "turn"])
    assert plain(store.read("m")) == before
    assert store.delete(spark.createDataFrame([("a", 3), ("a", 3), ("b", 1)], "id string, turn long"), "m", ["id", "turn"]) == 1
    assert plain(store.read("m")) == [r for r in before if r[1] != 3]


def test_statements_happen_together(store, spark):
    store.create("t", "n long", ["n"])
    with pytest.raises(Exception):  # noqa: B017
        store.execute('INSERT INTO "t" VALUES (1)', 'INSERT INTO "nowhere" VALUES (1)')
    assert store.read("t").count() == 0
