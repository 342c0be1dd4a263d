import re
from html import unescape

import pytest
from helpers import tuples
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanbase.operators import html
from gleanbase.operators.parse import main_content, parse_pages


def md(page):
    return re.sub(r"\n\s*\n", "\n\n", html.to_markdown(page)).strip()


@pytest.mark.parametrize("page,want", [
    ("<h1>A</h1><h3>B  b</h3><h6>C</h6>", "# A\n\n### B b\n\n###### C"),
    ("<ul><li>a</li><li>b<ul><li>c</li></ul></li></ul>", "- a\n- b\n  - c"),
    ("<ol><li>a</li><li>b</li></ol><ol start=5><li>c</ol>", "1. a\n2. b\n\n5. c"),
    ("x <a href='/u'>t</a> <a href='/v'></a><a>bare</a>", "x [t](/u) bare"),
    ("<b>a</b><strong> b </strong><i>c</i><em>d</em>", "**a** **b** *c**d*"),
    ("use <code>f_x*</code> not f_x*", "use `f_x*` not f\\_x\\*"),
    ("<pre>def f():\n    return 1*2</pre>", "```python\ndef f():\n    return 1*2\n```"),
    ("a<br>b<hr/>c", "a\nb\n\n---\n\nc"),
    ("<blockquote><p>q</p><p>r</p></blockquote>", "> q\n>\n> r"),
    ("<table><tr><th>a</th><th>b|c</th></tr><tr><td>1</td><td>2</td></tr></table>", "| a | b\\|c |\n| --- | --- |\n| 1 | 2 |"),
    ("a<img src=x alt=y>b<script>if (a</b) x</script><style>p{}</style><!-- c -->d", "abd"),
    ("<!DOCTYPE html><p>&lt;x&gt; &amp; &#233;</p>", "<x> & é"),
    ("<p>one <b>two</p> three</i> four", "one **two**\n\n three four"),
    ("<p>open<p>again", "open\n\nagain"),
    ("", ""), ("<", "<"), ("</p></div>text", "text"),
])
def test_markdown_contract(page, want):
    assert md(page) == want


WIKI = """<html><body><div id="mw-head">head</div><div id="mw-content-text"><p>Body<sup class="reference x">[1]</sup> &amp; more
<span class="mw-editsection">[edit]</span></p><div class="infobox"><p>box<div>deep</div></div><table class="navbox"><tr><td>n</table>
<p>tail</div><div id="footer">f</div></body></html>"""


def test_main_content():
    kept = html.main_content(WIKI)
    assert kept.startswith('<div id="mw-content-text">') and "tail" in kept and "&amp; more" in kept
    for gone in ("head", "[1]", "[edit]", "box", "deep", ">n<", "footer"):
        assert gone not in kept
    assert html.main_content("<p>none</p>") is None
    assert html.main_content('<div class="navbox"><p id="mw-content-text">x</p></div>') is None


def test_wiki_markdown_is_markdown_of_main_content():
    assert html.wiki_markdown(WIKI) == html.to_markdown(html.main_content(WIKI))


tags = st.sampled_from(["p", "b", "ul", "li", "ol", "table", "tr", "td", "pre", "a href='x'", "h2", "br", "script", "div id=m", "!--", "blockquote"])
soup = st.lists(st.one_of(tags.map(lambda t: f"<{t}>"), tags.map(lambda t: f"</{t.split()[0]}>"), st.text("ab <>&\n", max_size=6)), max_size=40).map("".join)


@settings(max_examples=300, deadline=None)
@given(soup)
def test_never_fails_on_tag_soup(page):
    assert isinstance(html.to_markdown(page), str)
    html.main_content(page, main="m")


@settings(max_examples=100, deadline=None)
@given(st.lists(st.text("abcé ", min_size=1, max_size=8), max_size=8))
def test_words_survive(words):
    page = "".join(f"<p>{w}</p><ul><li>{w}</li></ul>" for w in words)
    assert re.findall(r"\w+", unescape(html.to_markdown(page))) == re.findall(r"\w+", " ".join(f"{w} {w}" for w in words))


def test_deep_nesting():
    assert html.to_markdown("<div><b>" * 3000 + "x").strip().strip("*") == "x"


def test_parse_job(spark):
    rows = [
        (1, "https://a/1", "<h1>Old</h1>", "text/html", None), (2, "https://a/1", "<h1>New</h1>", "text/html", None),
        (3, "https://en.wikipedia.org/w", WIKI, None, None), (4, "https://en.wikipedia.org/none", "<p>x</p>", None, None),
        (5, "https://a/f.PDF", None, None, "pdf text [12]"), (6, "https://a/g", "%PDF", "application/pdf;v=1", None),
        (7, "", "<p>x</p>", None, None), (8, None, "<p>x</p>", None, None), (9, "https://a/empty", "", None, None),
        (10, "https://a/?q=wikipedia.org", "<p>x</p>", None, None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, content_type string, pdf_text string")
    out = {r["source_url"]: r for r in parse_pages(pages).collect()}
    assert len(out) == 7
    assert out["https://a/1"]["content"] == "# New" and out["https://a/1"]["error"] is None
    assert out["https://en.wikipedia.org/w"]["content"] == "Body & more\n\ntail"
    assert out["https://a/f.PDF"]["content"] == "pdf text"
    for lost in ("https://en.wikipedia.org/none", "https://a/g", "https://a/empty", "https://a/?q=wikipedia.org"):
        assert out[lost]["content"] is None and out[lost]["error"] == "no content"
    assert [r["source_url"] for r in parse_pages(pages, pdf_only=True).orderBy("source_url").collect()] == ["https://a/f.PDF", "https://a/g"]
    kept = main_content(pages.filter("page_id in (3, 4)"))
    assert [(i, c is None) for i, c in tuples(kept, "page_id", "content")] == [(3, False), (4, True)]
