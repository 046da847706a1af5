"""Chunks in buckets: a change leaves the files of other buckets alone."""

import os

import pytest
from pyspark.sql import functions as F

from quarryspark.sources.chunk_store import ChunkStore


def chunks(spark, rows):
    return spark.createDataFrame(rows, "source_type string, source_id string, chunk_index int, text string").withColumn("chunk_id", F.concat_ws("_", "source_id", "chunk_index"))


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, names in os.walk(path) for f in names if f.endswith(".parquet")}


def rows(frame):
    return sorted((r["source_type"], r["source_id"], r["chunk_index"], r["text"]) for r in frame.collect())


@pytest.fixture
def store(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "chunks"), 8)
    s.append(chunks(spark, [(("pdf", "web")[k % 2], f"s{k % 20}", k, f"t{k}") for k in range(200)]))
    return s


def test_deletion_leaves_other_files_alone(spark, store):
    before, old = files(store.path), rows(store.read())
    n = store.delete(spark.createDataFrame([("s3",), ("nowhere",)], "source_id string"))
    after = files(store.path)
    assert rows(store.read()) == [r for r in old if r[1] != "s3"]
    gone = set(before) - set(after)
    assert n == 1 and gone and len({os.path.dirname(f) for f in gone}) == 1 and all(before[f] == after[f] for f in set(before) & set(after))
    assert store.delete(spark.createDataFrame([("nowhere",)], "source_id string")) == 0 and files(store.path) == after


def test_an_emptied_bucket_goes_and_comes_back(spark, store):
    ids = [r[0] for r in store.read().select("source_id").distinct().collect()]
    store.delete(spark.createDataFrame([(i,) for i in ids], "source_id string"))
    assert store.read().count() == 0 and not files(store.path)
    store.append(chunks(spark, [("pdf", "s1", 0, "new")]))
    assert rows(store.read()) == [("pdf", "s1", 0, "new")]


def test_replacing_is_whole_and_can_be_repeated(spark, store):
    old = rows(store.read())
    new = [("web", "s1", 0, "again"), ("pdf", "s2", 0, "other type"), ("youtube", "s99", 0, "first")]
    for _ in range(2):
        store.replace(chunks(spark, new))
        assert rows(store.read()) == sorted([r for r in old if r[1] not in ("s1", "s2")] + new)
    assert rows(store.read(["s1", "s99"])) == sorted([new[0], new[2]])


def test_reading_a_source_reads_its_bucket(spark, store):
    found = store.read(["s5"])
    assert rows(found) == [r for r in rows(store.read()) if r[1] == "s5"]
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [bucket" in plan.replace("isnotnull(bucket", "bucket")
    assert len({r[0].rpartition("/")[0] for r in found.select(F.input_file_name()).distinct().collect()}) <= 2


def test_a_missing_store_is_empty(spark, tmp_path):
    s = ChunkStore(spark, str(tmp_path / "none"))
    assert s.read().count() == 0 and s.delete(spark.createDataFrame([("a",)], "source_id string")) == 0
    s.replace(chunks(spark, [("pdf", "a", 0, "x")]))
    assert rows(s.read()) == [("pdf", "a", 0, "x")]
