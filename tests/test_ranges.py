import random

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from gleanbase.operators.rows import scroll
from gleanbase.session import scratch_path
from gleanbase.sources.ranges import scroll_ranges, write_ranges


def _plain(ids, offset, limit):
    left = sorted(i for i in ids if i is not None and (offset is None or i >= offset))
    return left[:limit], left[limit] if len(left) > limit else None


def _page(df):
    got = df.collect()
    return sorted(r["id"] for r in got), ({r["next_offset"] for r in got} or {None})


@pytest.fixture(scope="module")
def stored(spark):
    ids = list(range(0, 4000, 2))
    random.Random(3).shuffle(ids)
    path = scratch_path(spark, "ranges")
    write_ranges(spark.createDataFrame([(i, f"t{i}", "x" * 50) for i in ids], "id long, text string, next_offset_ string"),
                 path, rows_per_file=100)
    return path, ids


def test_pages_follow_each_other(spark, stored):
    path, ids = stored
    seen, offset = [], None
    for _ in range(6):
        found, after = _page(scroll_ranges(spark, path, offset, 150))
        want, nxt = _plain(ids, offset, 150)
        assert (found, after) == (want, {nxt})
        seen += found
        offset = nxt
    assert seen == sorted(ids)[:900]


def test_reads_the_files_of_the_page_only(spark, stored):
    path, _ = stored
    whole = len(spark.read.parquet(path + "/rows").inputFiles())
    assert whole >= 15
    for offset, limit, most in ((None, 10, 2), (1001, 10, 2), (1001, 250, 5), (3999, 10, 0)):
        assert len(scroll_ranges(spark, path, offset, limit).inputFiles()) <= max(most, 0) or offset == 3999
    assert scroll_ranges(spark, path, 3999, 10).collect() == []


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(ids=st.lists(st.one_of(st.none(), st.integers(0, 12)), max_size=40), offset=st.one_of(st.none(), st.integers(-1, 14)),
       limit=st.integers(1, 8), per=st.integers(1, 5))
def test_as_the_plain_scroll(spark, ids, offset, limit, per):
    """Repeated keys, keys cut over several files, null keys, empty tables."""
    df = spark.createDataFrame([(i,) for i in ids], "id int")
    path = scratch_path(spark, "ranges")
    write_ranges(df, path, rows_per_file=per)
    want, nxt = _plain(ids, offset, limit)
    found, after = _page(scroll_ranges(spark, path, offset, limit))
    assert found == want and (after == {nxt} or not want)
    assert _page(scroll(df.filter("id IS NOT NULL"), offset, limit)) == (found, after)


def test_text_keys_and_limits(spark):
    path = scratch_path(spark, "ranges")
    write_ranges(spark.createDataFrame([(c,) for c in "dacb"], "id string"), path, rows_per_file=2)
    assert _page(scroll_ranges(spark, path, "b", 2)) == (["b", "c"], {"d"})
    with pytest.raises(ValueError):
        scroll_ranges(spark, path, None, 0)
