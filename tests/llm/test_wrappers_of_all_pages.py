"""A host's wrapper comes from all its pages."""

from quarryspark.llm import html_wrappers

PAGE = "<html><body><div class=top>Site of news</div><div class=story><h1>{0} title</h1><p>{0} first part of a story that is long enough</p><p>{0} second part of a story that is long enough</p></div><div class={1}>{2}</div></body></html>"


def test_template_is_what_nearly_all_pages_have(spark):
    """A text of three quarters of 400 pages stays, one of 0.85 goes, whatever few pages say at its place: no 8 pages can tell both."""
    pages = [PAGE.format(f"N{i}", "note", "Some of them" if i % 4 else f"Another of {i}") + ("<div class=end>Most of them</div>" if i % 20 > 2 else f"<div class=end>One of {i}</div>") for i in range(400)]
    rows = [(i, f"http://h.example/{i}", p) for i, p in enumerate([*pages, *[pages[1]] * 50])]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = {r["page_id"]: r["text"] for r in html_wrappers.extract_text(df).collect()}
    own = html_wrappers.infer(pages)
    assert "Most of them" in own["constant"] or own["template"]
    for i, _, page in rows:
        assert "Most of them" not in got[i] and "Site of news" not in got[i]
        assert got[i] == html_wrappers.main_text(page, own)


def test_order_and_copies_do_not_matter(spark):
    pages = [PAGE.format(f"N{i}", "abc"[i % 3], f"Text {i % 5}") for i in range(60)]
    form = lambda order, n: {(r["host"], r["size"], r["expression"], r["wrapper"]) for r in html_wrappers.host_wrappers(spark.createDataFrame([("h", pages[i]) for i in order], "host string, html string").repartition(n)).collect()}
    one = form(range(60), 1)
    assert len(one) == 1 and form([*reversed(range(60))], 5) == one
    assert {x[2:] for x in form([*range(60), *[3] * 40], 3)} == {x[2:] for x in one}


def test_packed_trees_are_the_same():
    root = html_wrappers.generalised(html_wrappers.tree("<div><ul><li>a<li>b</ul><p>c <b>d</b></p><nav>e</nav></div>"))
    assert html_wrappers.expression(html_wrappers.unpacked(html_wrappers.packed(root))) == html_wrappers.expression(root)
