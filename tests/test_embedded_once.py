"""Texts are embedded once, though chunks without an embedding are dropped; equal vectors are found by sums of their bits."""

import numpy as np
from pyspark.sql import functions as F

from quarryspark.operators import ingest, retrieve


def test_chunks_are_embedded_once(spark):
    d = spark.createDataFrame([("a", 0, "one two three", 1, "")], "source_id string, seg_idx int, text string, page_number int, section_heading string")
    p = spark.createDataFrame([("b", "https://x.org/", "<p>four five</p>")], "source_id string, url string, html string")
    for rows in (ingest.documents(d, at=F.current_timestamp()), ingest.pages(p, at=F.current_timestamp())):
        plan = rows._jdf.queryExecution().executedPlan().toString().partition("== Initial Plan ==")[0]
        assert sum("ArrowEvalPython [run(text" in line for line in plan.splitlines()) == 1
        assert rows.where("size(embedding) = 384").count() == 1


def test_equal_rows_share_a_number():
    r = np.random.default_rng(2)
    v = r.integers(-1, 2, (500, 4)) * 0.5 + 0.0
    number = {}
    assert all(number.setdefault(x.tobytes(), n) == n for x, n in zip(v, retrieve._same(v), strict=True))
    assert len(set(number.values())) == len(number) < 90
