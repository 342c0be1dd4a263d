import html
import re

from gleanbase.llm import content
from gleanbase.llm.queries import op3_main_text

SF = "/root/testdata/sf0.01"


def truth(page):
    """The article of the pages of the test tables, which mark it: by pattern, not by parser."""
    body = re.search(r"<article>(.*?)(?:</article>|<footer>|\Z)", page, re.S).group(1)
    body = re.sub(r"<!--.*?-->", "", body, flags=re.S)
    body = re.sub(r"</?(?:p|br|h1|ul|li)\b[^>]*>", " ", body)
    return " ".join(html.unescape(re.sub(r"<[^>]*>", "", body)).split())


def test_query(spark):
    pages = {r.page_id: r.html for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    rows = op3_main_text(spark, SF).collect()
    assert len(rows) == len(pages)
    for r in rows:
        assert r.text == truth(pages[r.page_id])
        assert r.n_chars == len(r.text)


PROSE = "It was late in the year and the river stood high between the fields, as it had done before. "

PAGES = [
    # no article element: the dense run, with its heading
    (f"<body><div class='menu'><a href=a>Home</a> <a href=b>News</a></div><h1>Floods</h1><p>{PROSE * 3}</p>"
     f"<p>{PROSE * 4}</p><p>{PROSE * 2}</p><div class='sidebar'><a href=c>More</a></div>"
     "<footer>Contact</footer></body>", ("Floods " + PROSE * 9).strip()),
    # boxes inside the article, short paragraphs, references, inline mark-up, reader comments
    (f"<article><h1>A &amp; B</h1><p>Sh<b>or</b>t.</p><div class='ad banner'>Buy!</div><p>{PROSE}&eacute;&#x41;&nbsp;x</p>"
     "<form>Mail <input></form><p>End.</p><div id='comments'><p>" + PROSE * 5 + "</p></div></article>",
     "A & B Short. " + PROSE + "éA x End."),
    # end tags left out, script with an end tag in a string, stray end tags
    (f"<html><head><title>T</title><script>var a='</p><p>no';</script><body><nav><ul><li><a>x<li><a>y</ul></nav>"
     f"<main><h2>One</h2><p>{PROSE}<p>{PROSE}</i></b><ul><li>first<li>second</ul></main><footer>f", 
     f"One {PROSE}{PROSE}first second"),
    ("", ""), ("<div></div><script>x</script>", ""), ("<nav>only <a>links</a></nav>", ""),
]


def test_pages():
    for page, want in PAGES:
        assert content.main_text(page) == want
    assert content.main_text(None) == ""


def test_odd_rows(spark, odd, empty):
    rows = content.extract(odd.withColumnRenamed("text", "html"), into="_th").collect()
    got = {r.doc_id: r["_th"] for r in rows if r.doc_id}
    assert len(rows) == odd.count() and got[1] == got[2] == got[3] == "" and got[5] == "one two three"
    assert len(got[4]) == len("alpha beta gamma delta " * 40_000) - 1
    deep = "<div>" * 20_000 + PROSE + "</div>" * 20_000
    assert content.main_text(deep) == PROSE.strip()
    assert content.extract(empty.withColumnRenamed("text", "html")).count() == 0


def test_hints_on_what_holds_the_text():
    text = (PROSE * 3).strip()
    box = "<div class='sidebar'><p>Other things to read here</p></div>"
    for page in (
        f"<body><div class='container right-sidebar'><p>{text}</p>{box}</div></body>",
        f"<body><div id='page' class='has-sidebar'><article><p>{text}</p></article>{box}</div></body>",
        f"<body><div class='nav-menu'><p>{PROSE}</p></div><main class='with-sidebar'><p>{text}</p>{box}</main></body>",
        f"<body><main class='sidebar'><p>{text}</p></main></body>",
        f"<body><article class='post category-social'><p>{text}</p>{box}</article></body>",
        f"<body><div class='no-comments'><p>{text}</p></div>{box}</body>",
        f"<body><article><div class='body with-sidebar'><p>{text}</p></div></article></body>",
        # readers' comments marked as articles still go
        f"<body><article><p>{text}</p></article><div id='comments'><article class='comment'><p>{PROSE}</p></article></div></body>",
        f"<body><article class='no-sidebar'><p>{text}</p><div id='comments'><article><p>{PROSE * 4}</p></article></div></article></body>",
    ):
        assert content.main_text(page) == text, page
    both = f"<article class='post tag-social'><p>{text}</p></article><article class='post tag-promo'><p>{PROSE}</p></article>"
    assert content.main_text(f"<body>{both}</body>") == f"{text} {PROSE.strip()}"


def test_what_surrounds_the_text_within_a_region():
    text = (PROSE * 6).strip()
    links = " | ".join(f"<a href=/{n}>topic {n}</a>" for n in range(40))
    teaser = "<article><h2><a href=/t>Another story</a></h2><p>It begins with a short line.</p></article>"
    for box in (f"<p>{links}</p>", "<p>Copyright 2024 The Paper. All rights reserved.</p>", "<p>&copy; 2023 The Paper</p>"):
        assert content.main_text(f"<body><article><p>{text}</p>{box}</article></body>") == text, box
        assert content.main_text(f"<body><main><p>{text}</p>{box}</main></body>") == text, box
    assert content.main_text(f"<body><article><p>{text}</p></article>{teaser * 6}</body>") == text
    for stays in ("<p>Copyright law was changed in 1998.</p>", "<p>See <a href=a>one</a>, <a href=b>two</a> and, above all, "
                  "the third of them, <a href=c>three</a>.</p>", "<ul><li><a href=a>first</a></li><li><a href=b>second</a></li></ul>",
                  "<h3><a href=a>Part</a> <a href=b>two</a> <a href=c>of</a> it</h3><p>Short.</p>"):
        want = " ".join(re.sub("<[^>]*>", " ", stays.replace("</a>,", "</a>\0,")).replace(" \0", "").split())
        found = content.main_text(f"<body><article><p>{text}</p>{stays}</article></body>")
        assert found.replace(" ", "") == (text + want).replace(" ", ""), stays
    # a year's notice in the midst is text
    assert content.main_text(f"<article><p>&copy; 2020 was printed below.</p><p>{text}</p></article>").startswith("\u00a9 2020")
    # links alone are better than nothing
    assert content.main_text("<article><p><a>a</a> <a>b</a> <a>c</a></p></article>") == "a b c"


def test_stray_end_tags_cost_no_more_than_their_number():
    import time
    begun = time.process_time()
    assert content.main_text(f"<article><p>{PROSE}" + "<b>" * 40_000 + "</i>" * 40_000 + "</p></article>") == PROSE.strip()
    assert content.main_text(f"<i><article><p>{PROSE}" + "<b>" * 40_000 + "</i>" * 40_000 + "</p></article>") == PROSE.strip()
    assert time.process_time() - begun < 10
