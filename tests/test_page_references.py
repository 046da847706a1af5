"""Text of pages with references that are cut off, and against the SQL."""

import duckdb
import pandas as pd

from quarryspark import queries
from quarryspark.sources import files

from .compare import plain, spark_rows

PAGES = [
    (1, "http://a.example/1", "<html><head><title>T</title></head><body><h1>x and&amp</h1><p>a &amp; b &lt;c&gt; &amp;lt; &nbsp;d</p></body></html>"),
    (2, "http://a.example/2", "<body><h1>cut &am</h1><p>R&ampD; &copy &lt</p></body>"),
    (3, "http://b.example/3", "<body><p>&quot;q&quot; &#39;s</p></body>"),
    (4, None, None),
]


def test_references_end_in_a_semicolon():
    assert files.text_of_page("<p>x&amp</p><p>a &amp; b</p>") == "\nx&amp\na & b\n"
    assert files.decoded("&ampx; &amp;lt; &#65;&#x42; &copy; &copy &nosuch; &#39") == "&ampx; &lt; AB © &copy &nosuch; &#39"


def test_texts_and_chunks_equal_sql(spark, tmp_path):
    pd.DataFrame(PAGES, columns=["page_id", "url", "html"]).to_parquet(tmp_path / "pages.parquet")
    assert spark_rows(queries.QUERIES["page_texts"](spark, str(tmp_path))) == pages_sql("page_texts", tmp_path)
    chunks = queries.QUERIES["page_chunks"](spark, str(tmp_path)).where("title is not null and title = 'T'")
    assert [r.text for r in chunks.collect()] == ["x and&amp\na & b <c> &lt; d"]


def pages_sql(name, path):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{path}/pages.parquet'")
    cur = con.execute(queries.SQL[name])
    cols = [d[0] for d in cur.description]
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in cur.fetchall()), key=repr)
