import random

from helpers import tuples
from pyspark.sql import functions as F

from gleanbase.operators import sketches as K


def test_any_span_is_near_the_whole(spark):
    rng = random.Random(1)
    rows = [(sync, f"id{rng.randrange(8000)}", int(rng.lognormvariate(6, 1))) for sync in range(10) for _ in range(4000)]
    df = spark.createDataFrame(rows, "sync int, id string, size long").repartition(6)
    stored = K.sketch(df, ["sync"], "id", "size").cache()
    assert stored.select(F.max(F.length("ids") + F.length("quantiles"))).first()[0] < 20_000
    shares = [0.01, 0.25, 0.5, 0.9, 0.99]
    for low, high in ((0, 1), (3, 7), (0, 10)):
        span = [r for r in rows if low <= r[0] < high]
        got = K.report(K.merge(stored.filter(f"sync >= {low} AND sync < {high}"), []), shares).first()
        true = len({r[1] for r in span})
        assert got.rows == len(span) and abs(got.distinct_ids - true) <= K.ID_ERROR * true
        sizes = sorted(r[2] for r in span)
        for share, value in zip(shares, got.sizes):
            below, upto = (sum(cmp(s) for s in sizes) / len(sizes) for cmp in (lambda s: s < value, lambda s: s <= value))
            assert below - K.RANK_ERROR <= share <= upto + K.RANK_ERROR


def test_merging_is_in_any_order_and_stepwise(spark):
    rows = [(n % 7, n % 3, f"id{n % 900}", n % 100) for n in range(3000)]
    df = spark.createDataFrame(rows, "sync int, channel int, id string, size long")
    stored = K.sketch(df, ["sync", "channel"], "id", "size")
    once = K.report(K.merge(stored, ["channel"]), [0.5])
    twice = K.report(K.merge(K.merge(stored.repartition(5), ["channel", "sync"]), ["channel"]), [0.5])
    assert tuples(once, "channel", "rows") == tuples(twice, "channel", "rows") == [(0, 1000), (1, 1000), (2, 1000)]
    for a, b in zip(once.orderBy("channel").collect(), twice.orderBy("channel").collect()):
        assert abs(a.distinct_ids - b.distinct_ids) <= K.ID_ERROR * 900 and abs(a.sizes[0] - b.sizes[0]) <= 2


def test_odd_rows(spark):
    df = spark.createDataFrame([(1, None, None), (1, "a", None), (2, "a", 5), (2, "a", 5), (None, "b", 7)], "sync int, id string, size long")
    got = tuples(K.report(K.sketch(df, ["sync"], "id", "size"), [0.0, 1.0]), "sync", "rows", "distinct_ids", "sizes")
    assert got == [(1, 2, 1, None), (2, 2, 1, [5, 5]), (None, 1, 1, [7, 7])]
    assert K.report(K.merge(K.sketch(df.filter("false"), ["sync"], "id", "size"), ["sync"]), [0.5]).count() == 0
