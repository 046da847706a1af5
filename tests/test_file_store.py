"""Database files in the shared folder, and the query of messages where executors are other processes."""

import pytest

from quarryspark import queries, table_queries
from quarryspark.sources.file_store import FileStore

from .compare import spark_rows, sql_rows

SCHEMA = "id string, turn long, text string"


def plain(df):
    return sorted(map(tuple, df.collect()), key=str)


def test_steps(spark):
    store = FileStore(spark, parts=3, batch=7)
    store.create("m", SCHEMA, ["id", "turn"])
    assert store.read("m").count() == 0
    first = [(f"a{k % 5}", k, f"o'b {k}" if k % 4 else None) for k in range(40)]
    store.append(spark.createDataFrame(first, SCHEMA).repartition(4), "m")
    assert plain(store.read("m")) == sorted(first, key=str)
    assert store.upsert(spark.createDataFrame([("a1", 1, "new"), ("b", 1, "x")], SCHEMA), "m", ["id", "turn"]) == 2
    assert store.delete(spark.createDataFrame([("a2", 2), ("a2", 2), ("c", 1)], "id string, turn long"), "m", ["id", "turn"]) == 1
    want = {(a, b): c for a, b, c in first} | {("a1", 1): "new", ("b", 1): "x"}
    del want["a2", 2]
    assert plain(store.read("m")) == sorted(((*k, v) for k, v in want.items()), key=str)
    assert plain(store.read("m", "turn > 30", ["turn"])) == sorted(((b,) for _, b in want if b > 30), key=str)
    before = plain(store.read("m"))
    with pytest.raises(Exception, match="UNIQUE"):
        store.append(spark.createDataFrame([("d", 1, "x"), ("d", 1, "y")], SCHEMA), "m")
    assert plain(store.read("m")) == before


def test_query_without_a_server(spark, sf_dir, monkeypatch):
    monkeypatch.setattr(table_queries, "has_database", lambda _: False)
    assert spark_rows(queries.QUERIES["messages_over_jdbc"](spark, sf_dir)) == sql_rows(queries.SQL["messages_over_jdbc"], sf_dir)
