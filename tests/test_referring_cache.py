"""Requests that carry the numbers of their vectors."""

import numpy as np
from pyspark.sql import functions as F

from quarryspark.streaming import cache, ordered
from quarryspark.table_queries import streamed
from tests.test_cache_stream import SCHEMA, by_hand, plain, requests


def test_numbers_stand_for_vectors(spark, monkeypatch):
    rows = [(*r[:4], None if r[4] is None else [float(np.float32(x)) for x in r[4]]) for r in requests()]
    df = spark.createDataFrame(rows, SCHEMA)
    vectors = df.select(F.col("request_id").alias("vec_id"), "embedding")
    monkeypatch.setattr(cache, "HELD", 299 * 4)
    assert cache.referring(vectors) is None
    monkeypatch.setattr(cache, "HELD", 1 << 20)
    kept, path = cache.referring(vectors)
    asked = df.drop("embedding").join(kept.withColumnRenamed("vec_id", "request_id"), "request_id").withColumn("pos", F.col("request_id"))
    got = streamed(asked, lambda s, late: cache.answered(s, 3, 0.95, 900.0, late, path), cache.RESULT)
    assert plain(map(tuple, got.collect())) == by_hand(rows, 3, 0.95, 900.0)


def test_state_holds_blocks_and_numbers():
    import pandas as pd

    from tests.test_ordered_lanes import _Lane

    lane = _Lane(cache.ReferringCache(3, 0.9, 60.0, "unused"))
    rows = pd.DataFrame({"key": "k", "us": range(1000), "pos": range(1000), "clears": False, "ref": 0, ordered.ABSENT: 0})
    list(lane.processor.handleInputRows((0,), iter([rows]), lane))
    assert len(lane.processor.waiting.rows) == 1 and len(lane.processor.waiting.rows[0][2]) < 20_000  # a row each before
    assert "double" not in cache.ReferringCache.held
