"""Texts that only some sampled pages of a host have stay in the article."""

import random
import time

from quarryspark.llm import html_wrappers

PAGE = "<html><body><div class=top>Site of news</div><div class=story><h1>{0} title</h1><p>{0} first part of a story that is long enough</p><p>{0} second part of a story that is long enough</p>{1}</div></body></html>"


def article(name, *more):
    return "\n".join([f"{name} title", f"{name} first part of a story that is long enough", f"{name} second part of a story that is long enough", *more])


def test_a_block_of_one_page_stays():
    pages = [PAGE.format("One", "<blockquote>Quoted words</blockquote>"), PAGE.format("Two", "")]
    w = html_wrappers.infer(pages)
    assert w["constant"] == ["Site of news"]
    assert [html_wrappers.main_text(p, w) for p in pages] == [article("One", "Quoted words"), article("Two")]


def test_repeated_pages_count_once():
    page = PAGE.format("One", "<blockquote>Quoted words</blockquote>")
    w = html_wrappers.infer([page, page, page, PAGE.format("Two", "")])
    assert html_wrappers.main_text(page, w) == article("One", "Quoted words")


def test_a_text_of_half_of_the_pages_stays_and_template_goes():
    pages = [PAGE.format(f"N{i}", "<blockquote>Quoted words</blockquote>" * (i % 2) + "<div>Read this too</div>" * (i > 0)) for i in range(8)]
    w = html_wrappers.infer(pages)
    assert "Read this too" in w["constant"] and "Quoted words" not in w["constant"]
    assert html_wrappers.main_text(pages[1], w) == article("N1", "Quoted words")


def test_slots_overrule_names_of_classes():
    """A class that is none of the article's by name doesn't hide the only prose of a page."""
    prose = "This is a sentence of the article with words. " * 13
    assert html_wrappers.main_text(f'<div class="content-widget"><p>{prose}</p></div><p>Home of things</p>', None) == prose.strip()
    assert html_wrappers.main_text(f'<div id="related-work"><p>{prose}</p></div><p>short</p>', None) == prose.strip()
    # with an article, or beside as much other text, the name counts
    assert html_wrappers.main_text(f'<article><p>It.</p><div class="share">tell</div></article><div class="related"><p>{prose}</p></div>', None) == "It."
    assert html_wrappers.main_text(f'<div><p>{prose}</p><p>{prose}</p></div><div class="promo"><p>{prose}</p></div>', None) == f"{prose.strip()}\n{prose.strip()}"
    assert html_wrappers.main_text(f'<div><p>It is short.</p></div><div class="comments"><p>{prose}</p></div>', None) == "It is short."


def test_a_long_page_of_many_kinds_of_blocks_is_linear():
    r = random.Random(1)
    kinds = ["<p>some text <b>bold</b> more <i>it</i> <a href=x>link</a></p>", "<div><p>a</p><ul><li>x<li>y <b>z</b></ul></div>", "<div><h2>t</h2><p>q</p><blockquote>z</blockquote></div>", "<h3>head</h3>", "<div><div><p>n</p></div><span>x</span></div>"]
    page = "<html><body>" + "".join(r.choice(kinds) for _ in range(24_000))
    began = time.perf_counter()
    text = html_wrappers.main_text(page, None)
    assert len(page) > 900_000 and text.count("\n") > 20_000
    assert time.perf_counter() - began < 30  # some 2 seconds alone; a quadratic scan takes a quarter of an hour
