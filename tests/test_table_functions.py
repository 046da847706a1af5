"""Chunking called from SQL gives what the operators give."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from quarryspark.functions import table_functions
from quarryspark.operators import chunking


@pytest.fixture(scope="module", autouse=True)
def registered(spark):
    table_functions.register(spark)


def test_split_text_laterally_keeps_provenance(spark):
    rows = [(k, k % 3, ("A sentence of some words. " * (k * 9)) + f"\n\nend {k}") for k in range(12)] + [(50, 0, None), (51, 1, "")]
    d = spark.createDataFrame(rows, "source_id long, page_number int, text string")
    d.createOrReplaceTempView("pages_of_text")
    got = spark.sql("SELECT p.source_id, p.page_number, c.chunk_in_segment, c.char_start, c.text FROM pages_of_text p, LATERAL split_text(p.text, 'pdf', 200, 20) c")
    want = chunking.split_segments(d, size=200, overlap=20).select("source_id", "page_number", "chunk_in_segment", "char_start", "text")
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect())) and got.count() > 12
    assert spark.sql("SELECT count(*) FROM pages_of_text p, LATERAL split_text(p.text) c").first()[0] > 0


def segments(spark):
    rows = [(f"v{k % 3}" if k % 7 else None, float((k * 37) % 400), k, (None, 5.0, 20.0)[k % 3], f"w{k}" if k % 5 else None) for k in range(120)]
    s = spark.createDataFrame(rows, "source string, at double, pos int, duration double, text string").repartition(4)
    s.createOrReplaceTempView("timed_segments")
    return s


def test_time_windows_ask_for_their_order(spark):
    s = segments(spark)
    got = spark.sql("SELECT * FROM time_windows(TABLE(timed_segments), 'source', 60)")
    assert got.columns == ["source", "chunk_index", "text", "timestamp_start", "timestamp_end"] and got.schema["source"].dataType.simpleString() == "string"
    ordered = s.withColumns({"start": F.col("at"), "order": F.struct("at", "pos")})
    want = chunking.duration_windows(ordered, ["source"], 60.0, "order")
    assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str)
    own = spark.sql("SELECT * FROM windows_of(TABLE(timed_segments) PARTITION BY source ORDER BY (at, pos), 60)")
    assert sorted(map(tuple, own.collect()), key=str) == sorted((tuple(r)[1:] for r in want.collect()), key=str)


@pytest.mark.parametrize("call", ["split_text(7)", "split_text('a', 'tape')", "time_windows(TABLE(timed_segments), 'nothing', 60)", "windows_of(TABLE(SELECT 1 AS at), 60)"])
def test_wrong_calls_are_told_at_analysis(spark, call):
    segments(spark)
    with pytest.raises(AnalysisException):
        spark.sql(f"SELECT * FROM {call}").schema  # noqa: B018
