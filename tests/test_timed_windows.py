"""Windows of a user with many events: streamed, and dealt to tasks by stretches."""

import random

from pyspark.sql import functions as F

from quarryspark import queries
from quarryspark.operators import chunking


def test_timed_windows_equal_the_fold(spark):
    r = random.Random(9)
    rows = []
    for user, steps in [(1, [0, 1, 5, 9, 10, 11, 30]), (2, [10]), (3, [0, 3]), (None, [1, 20]), (4, [0.5, 9.5, 10])]:
        at = -25.0
        for i in range(200):
            at += r.choice(steps)
            rows.append((user, i, None if i % 50 == 7 else f"e{i}", at, None if i % 3 else 0.0))
    rows += [(5, i, f"e{i}", None if i == 0 else 100.0 * i, 0.0) for i in range(5)] + [(6, 0, "a", 1.0, 4.0)]
    e = spark.createDataFrame(rows, "user long, pos int, text string, start double, duration double").repartition(5)
    got, want = chunking.timed_windows(e, ["user"], 10.0, ["pos"]), chunking.duration_windows(e, ["user"], 10.0)
    assert got.schema.names == want.schema.names
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(map(tuple, want.collect()), key=repr)
    parts = {x["user"]: x["n"] for x in chunking.stretches(e, ["user"], 10.0).groupBy("user").agg(F.countDistinct("_stretch").alias("n")).collect()}
    assert parts[2] == 200 and parts[1] > 20 and parts[3] == parts[5] == 1


def test_queries_gather_and_number_no_group(spark, sf_dir):
    plan = lambda name: queries.QUERIES[name](spark, sf_dir)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_list" not in plan("time_chunks") and "row_number" not in plan("time_chunks")
    assert "row_number" not in plan("sources_catalog")
