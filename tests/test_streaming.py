"""Streams give what the batch operators give."""

import datetime as dt
import json

from quarryspark.sources import files
from quarryspark.streaming import ingest as streams


def test_landed_pages(spark, tmp_path):
    land, table = tmp_path / "land", str(tmp_path / "chunks")
    land.mkdir()
    page = {"url": "http://h/a", "html": "<title>T</title><p>Some text.</p>", "fetched_at": "2026-01-01T00:00:00Z"}
    (land / "1.json").write_text(json.dumps(page) + "\n" + json.dumps(page) + "\n")
    rows = streams.landed(spark, str(land), "url string, html string, fetched_at timestamp")
    for _ in range(2):
        q = streams.ingest_pages(rows, table, str(tmp_path / "check")).trigger(availableNow=True).start()
        q.awaitTermination()
        (land / "2.json").write_text(json.dumps(page) + "\n")
    got = files.read_chunks(spark, table).collect()
    assert [(r.title, r.text) for r in got] == [("T", "Some text.")]


def test_windows_over_a_stream(spark, tmp_path):
    src = tmp_path / "seg"
    src.mkdir()
    put = lambda name, rows: (src / name).write_text("\n".join(json.dumps(dict(zip(("source_id", "pos", "text", "start", "duration"), r, strict=True))) for r in rows))
    put("1.json", [("v", 0, "Hello", 0.0, 5.0), ("v", 1, "world", 5.0, 5.0)])
    s = streams.landed(spark, str(src), "source_id string, pos int, text string, start double, duration double")
    out = []
    for k in range(2):
        w = streams.streaming_duration_windows(s).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(tmp_path / "c")).outputMode("append").trigger(availableNow=True).start()
        w.awaitTermination()
        if not k:
            put("2.json", [("v", 2, "end", 65.0, 5.0), ("v", 3, None, 70.0, 0.0)])
    assert sorted(out) == [("v", 0, "Hello world", 0, 10), ("v", 1, "end", 65, 70)]


def test_event_windows(spark):
    t = dt.datetime(2026, 1, 1, 10, 5)
    e = spark.createDataFrame([(t, "a", 1.0, 1), (t + dt.timedelta(minutes=10), "a", 2.0, 1), (t + dt.timedelta(hours=1), "a", 4.0, 1)], "ts timestamp, event_type string, value double, user_id int")
    assert sorted((r.n, r.total) for r in streams.event_windows(e).collect()) == [(1, 4.0), (2, 3.0)]
    assert sorted(r.n for r in streams.sessions(e).collect()) == [1, 2]
