import datetime as dt

from helpers import tuples
from pyspark.sql import functions as F

from gleanbase.operators import filters, rows
from gleanbase.operators.skew import hot_keys, salted_join, spread_join

RAW = "id string, source struct<url:string,content_type:string>"


def raw(spark):
    return spark.createDataFrame([
        ("1", ("https://en.wikipedia.org/wiki/A", "text/html")), ("2", ("http://en.wikipedia.org/wiki/A", None)),
        ("3", ("https://en.m.wikipedia.org/x", None)), ("4", (None, None)), ("5", ("", None)), ("6", None),
        ("7", ("https://a.org/f.pdf", None)), ("8", ("https://a.org/f", "application/pdf;v=1")),
        ("9", ("https://a.org/?u=wikipedia.org", None)),
    ], RAW)


def ids(df):
    return [r[0] for r in df.select("id").orderBy("id").collect()]


def test_source_filters(spark):
    assert ids(filters.has_source(raw(spark))) == list("12345789")
    assert ids(filters.has_source_url(raw(spark))) == list("123789")


def test_modes(spark):
    assert ids(filters.by_mode(raw(spark), "wikipedia_only")) == ["1"]
    assert ids(filters.by_mode(raw(spark), "pdf_only")) == ["7", "8"]
    assert len(ids(filters.by_mode(raw(spark), "all"))) == 9


def test_site_list_and_table_agree(spark):
    sites = ["https://a.org/", "http://en.wikipedia.org/"]
    table = spark.createDataFrame([(s,) for s in sites], "site string")
    assert ids(filters.site_allowed(raw(spark), sites)) == ids(filters.site_allowed(raw(spark), table)) == ["2", "7", "8", "9"]


def test_route_order(spark):
    df = raw(spark).filter("source.url <> ''")
    got = dict(tuples(df.withColumn("r", filters.route(F.col("source.url"), F.col("source.content_type"))), "id", "r"))
    assert got == {"1": "wiki", "2": "wiki", "3": "wiki", "7": "pdf", "8": "pdf", "9": "wiki"}
    only = dict(tuples(df.withColumn("r", filters.route(F.col("source.url"), F.col("source.content_type"), True)), "id", "r"))
    assert only["1"] == "skip" and only["7"] == "pdf"


def test_date_window_is_left_open_and_pushed(spark, sf):
    day = dt.datetime(2024, 1, 2)
    df = spark.createDataFrame([(1, day), (2, day + dt.timedelta(seconds=1)), (3, day + dt.timedelta(days=1)), (4, None)],
                               "id int, created_at timestamp")
    assert ids(filters.date_window(df, day, day + dt.timedelta(days=1))) == [2, 3]
    events = spark.read.parquet(f"{sf}/events.parquet")
    lit = [F.lit(f"2024-01-{d} 00:00:00").cast("timestamp_ntz") for d in ("02", "05")]
    plan = filters.date_window(events, *lit, "ts")._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(ts,2024-01-02" in plan and "LessThanOrEqual(ts,2024-01-05" in plan


def test_needs_parsing_and_lookup(spark):
    stored = spark.createDataFrame([("1", None), ("2", ""), ("3", "t")], "id string, crawled_text string")
    batch = spark.createDataFrame([("1",), ("2",), ("3",), ("4",)], "id string")
    assert ids(filters.needs_parsing(batch, stored)) == ["1", "4"]
    assert ids(filters.lookup(stored, batch.union(batch))) == ["1", "2", "3"]
    assert ids(filters.has_text(stored.union(spark.createDataFrame([("5", " ")], stored.schema)))) == ["3", "5"]


def test_last_per_key_sends_one_row_per_task(spark):
    df = spark.range(10_000).select(F.when(F.col("id") < 4000, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("n"))
    last = rows.last_per_key(df, ["k"], ["n"])
    assert last.filter("k = 0").first()["n"] == 3999 and last.count() == 6001
    assert "WindowGroupLimit" in last._jdf.queryExecution().executedPlan().toString()


def test_salted_join_equals_plain_join(spark):
    left = spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, 7).when(F.col("id") % 50 == 1, None)
                                    .otherwise(F.col("id") % 100).alias("k"))
    right = spark.range(80).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")).filter("k <> 5")
    right = right.union(right.filter("k = 7"))  # not unique either
    hot = hot_keys(left, "k", share=0.2, rows=10)
    assert [r[0] for r in hot.collect()] == [7]
    for how in ("inner", "left", "left_semi", "left_anti"):
        want = left.join(right, "k", how)
        got = salted_join(left, right, "k", how, F.col("id"), hot=hot, salts=4)
        short = spread_join(left, right, "k", how, F.col("id"), salts=4)
        assert tuples(got, *want.columns) == tuples(want, *want.columns) == tuples(short, *want.columns)


def test_sample_and_scroll(spark):
    df = spark.range(100)
    a, b = (tuples(rows.random_sample(df, 20, s), "id") for s in (1, 2))
    assert len(a) == 20 and a != b and a == tuples(rows.random_sample(df.repartition(7), 20, 1), "id")
    seen, offset = [], None
    while True:
        page = rows.scroll(df, offset, 30).orderBy("id").collect()
        seen += [r["id"] for r in page]
        offset = page[-1]["next_offset"]
        if offset is None:
            break
    assert seen == list(range(100))


def test_salts_follow_the_rows_of_a_key(spark, monkeypatch):
    """A key of a third of the rows is dealt so that no place holds many more than SALT_ROWS."""
    from gleanbase.operators import skew
    monkeypatch.setattr(skew, "SALT_ROWS", 100)
    left = spark.range(6000).select("id", F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id")).alias("k"))
    hot = hot_keys(left, "k", share=0.1, rows=10)
    assert tuples(hot, "k", "n") == [(-1, 2000)]
    right = left.select("k").distinct().withColumn("v", F.col("k") + 1)
    got = salted_join(left, right, "k", "inner", F.col("id"), hot=hot)
    assert got.count() == 6000 and got.filter("v <> k + 1").count() == 0
    salts = skew.salted_join.__globals__["SALT_ROWS"]
    per_place = left.filter("k = -1").groupBy(F.pmod(F.xxhash64("id"), F.lit(2000 // salts))).count()
    assert per_place.count() == 20 and per_place.agg(F.max("count")).first()[0] < 2 * salts
