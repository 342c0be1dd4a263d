import datetime as dt
import re

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanbase.functions import hits, text, urls, values


def one(spark, value, make, kind="string"):
    return spark.createDataFrame([(value,)], f"v {kind}").select(make(F.col("v")).alias("r")).first()[0]


def many(spark, items, make):
    rows = [(i, t) for i, t in enumerate(items)]
    return [r[0] for r in spark.createDataFrame(rows, "i int, v string").coalesce(1).orderBy("i").select(make(F.col("v"))).collect()]


def python_clean(t):
    if not t:
        return ""
    t = re.sub(r"\n\s*\n", "\n\n", t)
    t = re.sub(r"\[\d+\]", "", t)
    return t.replace("[edit]", "").replace("[]", "").strip()


CASES = [None, "", "  ", "a\n \t\n\n b", "a\n \n\x1c\nb", "x[3] y[33] z[١٢]", "[edit]Head[edit]", "[](u) [] [a[1]]",
         " \x1cmid ", "[1[2]]", "a\x0b\x0c\n\x85\nb", "\n\n\n", "a\r\n\r\nb", "tail\n", "tail  "]


def test_clean_markdown_cases(spark):
    assert many(spark, CASES, text.clean_markdown) == [python_clean(t) for t in CASES]


@settings(max_examples=15, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.text(alphabet="ab\n\t  \x1c\x1f  \x85[]123١edit", max_size=40), min_size=30, max_size=60))
def test_clean_markdown_like_python(spark, items):
    assert many(spark, items, text.clean_markdown) == [python_clean(t) for t in items]


def test_preview_counts_code_points(spark):
    for n in (199, 200, 201):
        body = "x" * (n - 1) + "\U0001f600"
        assert one(spark, body, text.preview) == body[:200]


def test_site(spark):
    given_ = ["HTTPS://User@Example.org:8080/a?b", "https://en.wikipedia.org", "http://x.y/a b", "no scheme", "https://h#f"]
    assert many(spark, given_, urls.site) == [
        "https://User@Example.org:8080/", "https://en.wikipedia.org/", "http://x.y/", ":///", "https://h/"]


def test_is_pdf(spark):
    rows = [("http://a/x.PDF", None, True), ("http://a/x.pdf?dl=1", None, False), ("http://a/x", "Application/PDF;v=1", True),
            ("http://a/x", None, False), (None, None, False), ("http://a/x", "text/html", False)]
    df = spark.createDataFrame(rows, "u string, c string, want boolean")
    assert all(r[0] == r[1] for r in df.select(urls.is_pdf(F.col("u"), F.col("c")), "want").collect())


def test_metadata_and_defaults(spark):
    assert many(spark, ["{}", "{ }", "", "null", None, '{"a":1}'], values.metadata_or_null) == [None] * 5 + ['{"a":1}']
    assert many(spark, ["", None, "t"], lambda c: values.text_or(c, "Untitled")) == ["Untitled", "Untitled", "t"]
    assert many(spark, ["12", " 7x", "x", None, "-3", "99999999999"], lambda c: values.int_or(c, 10)) == [12, 7, 10, 10, -3, 10]
    assert many(spark, ['{"k": 5}', '{"k"', None, '{"z": 1}'], lambda c: values.json_field(c, "$.k", "int")) == [5, None, None, None]
    assert many(spark, ['{"k": 5}', '{"k"', None, ""], values.is_bad_json) == [False, True, False, False]


def test_as_time(spark):
    got = many(spark, ["2024-01-02T03:04:05Z", "2024-01-02", "soon", None], values.as_time)
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5), dt.datetime(2024, 1, 2), None, None]


def test_record_ids_of_one_second_differ(spark):
    at = dt.datetime(2025, 1, 2, 3, 4, 5)
    df = spark.createDataFrame([(at, "https://a/1"), (at, "https://a/2")], "at timestamp, u string")
    ids = [r[0] for r in df.select(values.record_id("manual_", F.col("at"), F.col("u"))).collect()]
    assert len(set(ids)) == 2 and all(i.startswith("manual_20250102_030405_") for i in ids)


def test_hit_and_context_text(spark):
    df = spark.createDataFrame([(1, 0.12345, "T", None, "body")], "rank int, s double, t string, u string, p string")
    line, entry = df.select(hits.hit_text(F.col("s"), F.col("t"), F.col("u"), F.col("p")),
                            hits.context_entry(F.col("rank"), F.col("t"), F.col("u"), F.col("p"))).first()
    assert line == "Score: 0.123\nTitle: T\nURL: None\nPreview: body..."
    assert entry == "Document 1:\nTitle: T\nURL: None\nContent: body\n"


def test_strip_html(spark):
    page = "<p>a<script>x<y</script> b<!-- <i>c</i> --></p>\n<STYLE a=1>q</STYLE >d"
    assert one(spark, page, text.strip_html) == "a b d"
