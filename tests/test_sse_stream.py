"""Frames from files that grow, cut anywhere, give what a parser of the whole gives."""

import random

import pytest

from quarryspark.sources import sse, sse_stream
from quarryspark.streaming import ordered


def test_lines_between_any_cuts(monkeypatch):
    r = random.Random(3)
    for _ in range(300):
        monkeypatch.setattr(sse_stream, "STEP", r.choice((1, 2, 5, 1 << 16)))
        raw = "".join(r.choice(("data: ", "é", "\n", "x", "\n\n")) for _ in range(r.randint(0, 40))).encode()
        cuts = sorted({0, len(raw), *(r.randint(0, len(raw)) for _ in range(r.randint(0, 6)))})
        got = [x for a, b in zip(cuts, cuts[1:], strict=False) for x in sse_stream.lines_between(lambda at, n: raw[at : at + n], a, b)]
        want, at = [], 0
        for line in raw.split(b"\n")[:-1]:
            want.append((at, line))
            at += len(line) + 1
        assert got == want


@pytest.fixture
def rocksdb(spark):
    before = spark.conf.get("spark.sql.streaming.stateStore.providerClass", None)
    ordered.use_rocksdb(spark)
    yield
    if before:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", before)


def step(lines, out, check):
    w = sse_stream.answer_parts(lines).writeStream.foreachBatch(lambda b, _: out.extend(map(tuple, b.collect()))).option("checkpointLocation", str(check))
    w.outputMode("append").trigger(availableNow=True).start().awaitTermination()


def test_growing_files_and_restarts(spark, tmp_path, rocksdb):
    r = random.Random(1)
    answers = {f"a{k}": " ".join(r.choice(("wörd", "中文", "x", "data:")) for _ in range(r.randint(1, 12))) for k in range(5)}
    whole = {k: ("".join(f"data: {w} \n\n" for w in t.split()) + "data: [DONE]\n\ndata: after \n\n").encode() for k, t in answers.items()}
    land, out = tmp_path / "land", []
    land.mkdir()
    sent = dict.fromkeys(whole, 0)
    lines = sse_stream.frames_stream(spark, str(land))
    for turn in range(4):
        for k, raw in whole.items():
            upto = len(raw) if turn == 3 else r.randint(sent[k], len(raw))
            with open(land / k, "ab") as f:
                f.write(raw[sent[k] : upto])
            sent[k] = upto
        step(lines, out, tmp_path / "check")  # a new query each time
    frame = spark.createDataFrame([(k, raw.decode()) for k, raw in whole.items()], "stream string, raw string")
    want = {r.stream: r.text for r in sse.joined(sse.parsed(frame, "stream", "raw"), "stream").collect()}
    got = spark.createDataFrame(out, sse_stream.LINES)
    assert got.select("stream", "pos").distinct().count() == len(out)
    assert {r.stream: r.text for r in sse.joined(got, "stream").collect()} == want
    assert want == {k: "".join(f"{w} " for w in t.split()) for k, t in answers.items()}


def test_an_error_line_fails_unless_the_answer_is_over(spark, tmp_path, rocksdb):
    land = tmp_path / "land"
    land.mkdir()
    (land / "fine").write_text("data: a \n\ndata: [DONE]\n\ndata: [ERROR]\n\n")
    out = []
    step(sse_stream.frames_stream(spark, str(land)), out, tmp_path / "c")
    assert [(s, d) for s, _, d in out] == [("fine", "a ")]
    (land / "broken").write_text("data: a \n\ndata: [ERROR]\n\n")
    with pytest.raises(Exception, match="ERROR"):
        step(sse_stream.frames_stream(spark, str(land)), out, tmp_path / "c")
