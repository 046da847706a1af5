"""Splitting holds the chunks of a few texts, not of a whole Arrow batch."""

from quarryspark.operators import chunking


def test_chunks_are_made_in_steps(spark):
    rows = [(k, ["x", None], {"a": k}, None if k % 7 == 0 else f"w{k}. " * (k % 900)) for k in range(300)]
    d = spark.createDataFrame(rows, "source_id long, tags array<string>, m map<string,int>, text string").coalesce(1)
    found = chunking.split_segments(d)
    plan = found._jdf.queryExecution().executedPlan().toString()
    assert "MapInArrow" in plan and "ArrowEvalPython" not in plan and "Generate" not in plan
    assert found.columns == ["source_id", "tags", "m", "chunk_in_segment", "text", "char_start"]
    want = sorted((k, n, c, at) for k, _, _, t in rows for n, (c, at) in enumerate(chunking.split_text(t or "")))
    got = found.collect()
    assert sorted((r.source_id, r.chunk_in_segment, r.text, r.char_start) for r in got) == want
    assert all(r.tags == ["x", None] and r.m == {"a": r.source_id} for r in got)
