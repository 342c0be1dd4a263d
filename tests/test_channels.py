import json

from helpers import tuples

from gleanbase import schemas
from gleanbase.operators.rows import last_per_key
from gleanbase.sources import channels as C
from gleanbase.sources.files import read_blocks_csv


def sizes(spark, rows):
    return spark.createDataFrame(rows, "channel string, page long, n long")


def test_last_pages(spark):
    got = dict(tuples(C.last_pages(sizes(spark, [
        ("short", 1, 100), ("short", 2, 100), ("short", 3, 37), ("short", 4, 100),
        ("zero", 1, 100), ("zero", 2, 0),
        ("gap", 1, 100), ("gap", 3, 100),
        ("late", 2, 100),
        ("full", 1, 100), ("full", 2, 100),
        ("long", 1, 101), ("long", 2, 100),
    ])), "channel", "last_page"))
    assert got == {"short": 3, "zero": 2, "gap": 1, "late": 0, "full": 2, "long": 1}


def block(i, **more):
    return {"id": i, "title": f"t{i}", "metadata": {"a": 1}, "source": {"url": f"https://x/{i}"}, **more}


def test_landed_json(spark, tmp_path):
    pages = [
        {"channel": "a", "page": 1, "contents": [block(1), block(2, source=None)]},
        {"channel": "a", "page": 2, "contents": [block(1, title="again", image={"square": {"url": "s"}})]},
        {"channel": "b", "page": 1, "contents": None},
        {"channel": "c", "page": 1, "contents": []},
    ]
    (tmp_path / "pages.json").write_text("\n".join(json.dumps(p) for p in pages))
    (tmp_path / "heads.json").write_text(json.dumps({"slug": "a", "title": "Channel A", "contents": [block(9)]}))
    read = C.read_pages(spark, str(tmp_path / "pages.json"))
    flat = C.flatten(read)
    assert tuples(flat, "channel", "page", "pos", "id") == [("a", 1, 0, "1"), ("a", 1, 1, "2"), ("a", 2, 0, "1")]
    assert json.loads(flat.filter("page = 2").first()["metadata"]) == {"a": 1}
    assert tuples(C.channel_blocks(read, per=2), "page", "id") == [(1, "1"), (1, "2"), (2, "1")]
    last = last_per_key(flat, ["id"], ["channel", "page", "pos"])
    assert tuples(last, "id", "title", "image.square.url") == [("1", "again", "s"), ("2", "t2", None)]
    titled = C.with_headers(read, C.read_headers(spark, str(tmp_path / "heads.json")))
    assert tuples(titled, "channel", "page", "title") == [("a", 1, "Channel A"), ("a", 2, "Channel A"), ("b", 1, None), ("c", 1, None)]


def test_channels_per_block_and_union(spark):
    rows = spark.createDataFrame([("1", "b"), ("1", "a"), ("1", "b"), ("2", "c")], "id string, channel string")
    assert tuples(C.channels_per_block(rows), "id", "channels") == [("1", ["a", "b"]), ("2", ["c"])]
    both = C.union_blocks(rows, rows)
    assert both.count() == 8 and tuples(both.select("channel_ord").distinct(), "channel_ord") == [(0,), (1,)]


def test_csv_sample_form(spark, tmp_path):
    (tmp_path / "s.csv").write_text('block_id,title,description,source_url\n1,"A ""b""","two\nlines, here",https://x/1\n2,,,https://x/2\n')
    df = read_blocks_csv(spark, str(tmp_path / "s.csv"))
    assert df.schema == schemas.SAMPLE_CSV
    assert tuples(df, *df.columns) == [("1", 'A "b"', "two\nlines, here", "https://x/1"), ("2", None, None, "https://x/2")]
