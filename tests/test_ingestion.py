"""Readers, chunking, embedding and the chunk table."""

import io
import zipfile

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from quarryspark import schemas
from quarryspark.functions import text as T
from quarryspark.operators import catalog, chunking, ingest
from quarryspark.sources import files, models

def AT():
    return F.lit("2026-05-11").cast("timestamp")


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, c):
    return spark.range(1).select(c.alias("x")).first()["x"]


@pytest.mark.parametrize("url,want", [("https://www.youtube.com/watch?v=dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://youtu.be/dQw4w9WgXcQ", "dQw4w9WgXcQ"), ("https://youtu.be//a/b", "a/b"), ("https://www.youtube.com/watch?x=1", None), ("https://www.youtube.com/watch?v=a%20b&v=c", "a b")])
def test_video_ids(spark, url, want):
    assert value(spark, T.video_id(F.lit(url))) == want


def test_transcript_windows(spark):
    rows = [("v", 0, "Hello", 0.0, 5.0), ("v", 1, "world", 5.0, 5.0), ("v", 2, "end", 65.0, 5.0), ("w", 0, "long", 0.0, 200.0), ("w", 1, "x", 200.0, None)]
    segments = spark.createDataFrame(rows, schemas.TRANSCRIPT)
    want = {("v", 0, "Hello world", 0, 10), ("v", 1, "end", 65, 70), ("w", 0, "long", 0, 200), ("w", 1, "x", 200, 200)}
    assert {tuple(r) for r in chunking.duration_windows(segments, ["source_id"]).collect()} == want
    assert {tuple(r) for r in chunking.long_duration_windows(segments, ["source_id"]).collect()} == want
    assert chunking.duration_windows(segments.where("1 = 0"), ["source_id"]).count() == 0


def test_both_window_forms_agree(spark, sf_dir):
    e = spark.read.parquet(f"{sf_dir}/events.parquet")
    s = e.select("user_id", F.col("event_id").alias("pos"), F.col("event_type").alias("text"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("start"), F.lit(30.0).alias("duration"))
    a, b = chunking.duration_windows(s, ["user_id"], 7200.0), chunking.long_duration_windows(s, ["user_id"], 7200.0)
    assert sorted(map(tuple, a.collect())) == sorted(map(tuple, b.collect()))


def test_seconds_are_rounded_half_to_even(spark):
    assert [value(spark, T.whole_seconds(F.lit(x))) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]


def test_ingested_transcript(spark):
    segments = spark.createDataFrame([("s", 0, "attention is all you need", 0.0, 30.0)], schemas.TRANSCRIPT)
    videos = spark.createDataFrame([("s", "https://youtu.be/abc", '"title":"T","ownerChannelName":"C"')], "source_id string, url string, html string")
    r = one(ingest.transcripts(segments, videos, at=AT()))
    assert (r.chunk_id, r.title, r.channel, r.video_id, r.timestamp_start, r.timestamp_end, r.source_type, len(r.embedding)) == ("s_0", "T", "C", "abc", 0, 30, "youtube", 384)
    r = one(ingest.transcripts(segments, videos.withColumn("html", F.lit(None).cast("string")), at=AT()))
    assert (r.title, r.channel) == ("https://youtu.be/abc", "Unknown")


def test_web_page(spark):
    html = "<html><head><title> Test Page </title><style>x</style></head><body><script>1</script><p>Hello world content &amp; here.</p><!-- c --><table><tr><td>t</td></tr></table></body></html>"
    pages = spark.createDataFrame([("s", "https://u:p@Ex.com:80/a", html), ("e", "https://e.com", "<p> </p>"), ("n", "https://n.com", "<p>x</p>")], "source_id string, url string, html string")
    rows = {r.source_id: r for r in ingest.pages(pages, at=AT()).collect()}
    assert (rows["s"].title, rows["s"].text, rows["s"].domain, rows["s"].chunk_id) == ("Test Page", "Hello world content & here.", "u:p@Ex.com:80", "s_0")
    assert rows["n"].title == "https://n.com" and "e" not in rows
    assert one(ingest.empty_pages(pages)).source_id == "e"


def test_fetching_keeps_errors_with_their_rows(spark):
    def fetch(url):
        if "bad" in url:
            raise OSError("503")
        return f"<title>{url}</title>"

    got = {r.url: (r.html, r.error) for r in files.fetched(spark.createDataFrame([("a",), ("bad",)], "url string"), fetch).collect()}
    assert got == {"a": ("<title>a</title>", None), "bad": (None, "OSError: 503")}


def test_text_files(spark, tmp_path):
    (tmp_path / "a.txt").write_bytes(b"ok \xff")
    r = one(files.text_segments(files.read_files(spark, str(tmp_path), "*.txt")))
    assert r.text == "ok �" and r.page_number is None and r.section_heading is None


def test_content_types(spark):
    f = spark.createDataFrame([("a", "text/plain"), ("b", "image/png"), ("c", None)], "path string, content_type string")
    assert [r.kind for r in files.with_kind(f).orderBy("path").collect()] == ["text", None, None]
    assert {r.path for r in files.rejected(f).collect()} == {"b", "c"}


def test_pdf_pages_ocr_and_headings(spark):
    def parser(content):
        yield 1, "body", [(12.0, "small text"), (20.0, "Big title"), (20.0, "Other title"), (30.0, "abc")]
        yield 2, "  ", []
        yield 3, "more", [(12.0, "not large")]
        yield 4, " ", []

    def ocr(content, page):
        if page == 4:
            raise RuntimeError
        return "scanned"

    f = spark.createDataFrame([("x.pdf", bytearray(b"%PDF"))], "path string, content binary")
    got = [(r.page_number, r.seg_idx, r.text, r.section_heading) for r in files.pdf_pages(f, parser, ocr).orderBy("page_number").collect()]
    assert got == [(1, 0, "body", "Big title"), (2, 1, "scanned", None), (3, 2, "more", None)]


def test_pdf_fallback_reader(spark):
    def missing(content):
        raise ImportError

    f = spark.createDataFrame([("x.pdf", bytearray(b"%PDF"))], "path string, content binary")
    r = one(files.pdf_pages(f, missing, fallback=lambda c: iter([(1, "plain", [(40.0, "Heading")])])))
    assert (r.text, r.section_heading) == ("plain", None)


def test_docx_sections(spark):
    w = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    p = lambda t, style="": f'<w:p>{f"<w:pPr><w:pStyle w:val={chr(34)}{style}{chr(34)}/></w:pPr>" if style else ""}<w:r><w:t>{t}</w:t></w:r></w:p>'
    body = "".join([p("before"), p("One", "Heading1"), p("a"), p(" "), p("b"), p("", "Heading2"), p("c"), p("Empty", "Heading1"), p("Two", "Heading1"), p("d")])
    raw = io.BytesIO()
    with zipfile.ZipFile(raw, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{w}"><w:body>{body}</w:body></w:document>')
    f = spark.createDataFrame([("x.docx", bytearray(raw.getvalue()))], "path string, content binary")
    got = [(r.section_heading, r.text) for r in chunking.sections(files.docx_paragraphs(f)).orderBy("seg_idx").collect()]
    assert got == [(None, "before"), ("One", "a\nb"), ("One", "c"), ("Two", "d")]


def test_document_chunks(spark):
    rows = [("s", 0, "Sample text", 1, "Intro", "doc.pdf"), ("s", 1, "   ", 2, None, "doc.pdf"), ("s", 2, "x " * 1500, None, None, "doc.pdf")]
    seg = spark.createDataFrame(rows, "source_id string, seg_idx int, text string, page_number int, section_heading string, filename string")
    got = ingest.documents(seg, at=AT()).orderBy("chunk_index").collect()
    assert [r.chunk_index for r in got] == list(range(len(got))) and len(got) >= 3
    assert (got[0].chunk_id, got[0].text, got[0].page_number, got[0].section_heading, got[0].filename) == ("s_0", "Sample text", 1, "Intro", "doc.pdf")
    assert (got[-1].page_number, got[-1].section_heading) == (0, "")


@settings(max_examples=60, deadline=None)
@given(st.text(alphabet="ab .!?;,\né", max_size=600), st.integers(5, 60))
def test_splitter_invariants(text, size):
    overlap = size // 4
    chunks = chunking.split_text(text, size=size, overlap=overlap)
    covered = set()
    for c, at in chunks:
        assert c and c == c.strip() and len(c) <= size and text[at : at + len(c)] == c
        covered.update(range(at, at + len(c)))
    assert all(ch.isspace() for i, ch in enumerate(text) if i not in covered)
    for (a, x), (_, y) in zip(chunks, chunks[1:], strict=False):
        assert y > x and x + len(a) - y <= overlap


def test_embedder(spark):
    e = models.hashing_embedder()()
    assert e(["a", "b c"]).shape == (2, 384) and e(["a"]).dtype == np.float32 and abs(np.linalg.norm(e(["b c"])[0]) - 1) < 1e-6

    def broken():
        raise OSError

    d = spark.createDataFrame([("a",), (None,)], "t string")
    assert [r.e is None for r in d.select(models.embedded(F.col("t"), models.hashing_embedder(8)).alias("e")).collect()] == [False, True]
    assert all(r.e is None for r in d.select(models.embedded(F.col("t"), broken).alias("e")).collect())
    seg = spark.createDataFrame([("s", 0, "t", 1, None)], "source_id string, seg_idx int, text string, page_number int, section_heading string")
    assert ingest.documents(seg, broken, AT()).count() == 0


def test_chunk_table(spark, tmp_path):
    path = str(tmp_path / "chunks")
    seg = spark.createDataFrame([("s", 0, "text one", 1, None), ("t", 0, "text two", 1, None)], "source_id string, seg_idx int, text string, page_number int, section_heading string")
    chunks = ingest.documents(seg, at=AT())
    files.append_chunks(chunks, path)
    files.append_chunks(ingest.only_new(chunks, files.read_chunks(spark, path)), path)
    stored = files.read_chunks(spark, path)
    assert stored.count() == 2
    left, status = catalog.delete_source(stored, "s")
    assert status == 200 and [r.source_id for r in left.collect()] == ["t"]
    assert catalog.delete_source(stored, "none")[1] == 404
    assert files.read_chunks(spark, files.replace_chunks(left, str(tmp_path / "chunks2"))).count() == 1
    plan = stored.where("source_type = 'pdf' and source_id = 's'").select("chunk_id")._jdf.queryExecution().toString()
    assert "PartitionFilters: [isnotnull(source_type" in plan and "EqualTo(source_id,s)" in plan and "embedding" not in plan.split("ReadSchema")[-1]


def test_catalogue(spark):
    rows = [("1", "s", "web", 1, None, "late", "u", None), ("2", "s", "web", 0, None, "first", "u", None), ("3", "v", "youtube", 0, None, "clip", None, "watch"), ("4", "", "pdf", 0, "f", None, None, None), ("5", "p", "pdf", 0, "f.pdf", None, None, None)]
    chunks = schemas.conform(spark.createDataFrame(rows, "chunk_id string, source_id string, source_type string, chunk_index int, filename string, title string, url string, video_url string"), schemas.CHUNKS)
    found = catalog.labelled_sources(catalog.list_sources(chunks))
    assert {(r.source_id, r.label, r.chunks, r.date) for r in found.collect()} == {("s", "first", 2, ""), ("v", "clip", 1, ""), ("p", "f.pdf", 1, "")}
    assert [(r.source_type, r.sources) for r in catalog.grouped_sources(found).collect()] == [("pdf", 1), ("youtube", 1), ("web", 1)]
    assert catalog.list_sources(chunks.where("1 = 0")).count() == 0
    assert value(spark, catalog.toggled(F.array(F.lit("a"), F.lit("b")), F.lit("a"))) == ["b"] and value(spark, catalog.toggled(F.array(F.lit("b")), F.lit("a"))) == ["b", "a"]


def test_ddl_and_added_columns(spark):
    spark.sql("CREATE DATABASE IF NOT EXISTS q_test")
    schemas.create_tables(spark, "q_test")
    schemas.create_tables(spark, "q_test")
    assert schemas.add_missing_columns(spark, "q_test.folders", {"name": "string", "colour": "string"}) == ["colour"]
    assert spark.table("q_test.folders").columns == ["id", "name", "created_at", "colour"]
    spark.sql("DROP DATABASE q_test CASCADE")


def test_violations(spark):
    m = spark.createDataFrame([("user",), ("system",), (None,)], "role string")
    f = spark.createDataFrame([("a",), ("a" * 101,), (None,)], "name string")
    assert schemas.violations(m, "messages").count() == 2 and schemas.violations(f, "folders").count() == 2


def test_synthetic_text_and_json(spark, tmp_path):
    rows = files.synthetic_texts(spark.createDataFrame([("a", 300, "lorem ipsum", "A fact here.")], "name string, size long, filler string, facts string")).collect()
    assert rows[0].text[100:114] == " A fact here. " and len(rows[0].text) == 314
    d = spark.createDataFrame([(1, "a")], "n int, s string")
    assert one(files.as_json(d)).json == '{"n":1,"s":"a"}'
    files.write_json(d, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 1


def test_furniture_without_an_end_tag():
    read = lambda p: files.text_of_page(p).strip()
    assert read("<nav>menu<p>article text</p>") == "menu\narticle text"
    assert read("<body><div><nav>menu<ul><li>a</ul></div><p>article</p><nav>other</nav>") == "article"
    assert read("<div><nav><div>menu</div></nav></div><p>article</p><footer>f</footer>") == "article"
    assert read("<p>one<header>top</header><p>two<table><tr><td>cell</table>three") == "one\ntwothree"
    assert read("<nav>a<nav>b</nav>c</nav>d") == "d"
