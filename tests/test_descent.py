import numpy as np
import pytest
from helpers import tuples
from pyspark.sql import functions as F
from test_similarity import brute, frame, make, shown

from gleanbase.operators import descent as D
from gleanbase.operators import graph as G
from gleanbase.operators import similarity as S
from gleanbase.plans.queries import QUERIES


def share(hits, ids, m, k):
    truth = {(q, i) for q, _, i, _ in brute(ids, m, ids, m, k)}
    return len(truth & {(r.query_id, r.id) for r in hits.collect()}) / len(truth)


@pytest.mark.parametrize("hot", [False, True])
def test_finds_nearly_all(spark, hot):
    ids, m = make(600, hot=hot)
    hits = D.descent_top_k(frame(spark, ids, m), 6).cache()
    assert share(hits, ids, m, 6) > 0.95
    truth = {(q, i): s for q, _, i, s in brute(ids, m, ids, m, 600)}
    assert all(truth[q, i] == s for q, _, i, s in shown(hits))  # what is found has its true score
    assert tuples(hits.groupBy("query_id").agg(F.count("*").alias("n"), F.max("rank").alias("r")), "n", "r") == [
        (6, 6)] * (599 if hot else 600)


def test_groups_and_lists_are_bounded(spark):
    """Points that all others name take no more than their share in a round."""
    rng = np.random.default_rng(5)
    star = [(f"p{n:03d}", "p000", float(rng.random()), n % 2 == 0) for n in range(1, 500)]
    rest = [(f"p{n:03d}", f"p{(n * 7 + j) % 500:03d}", 0.1, True) for n in range(500) for j in range(1, 5)]
    lists = spark.createDataFrame(star + rest, "id string, nb string, score double, fresh boolean")
    near = D.neighbourhoods(lists, 5, 1)
    assert near.groupBy("v").count().agg(F.max("count")).first()[0] <= 10
    assert near.count() <= 2 * 5 * 500
    again = D.neighbourhoods(lists.repartition(7), 5, 1)
    assert tuples(near, "v", "m", "fresh") == tuples(again, "v", "m", "fresh")  # a task run again does the same


def test_work_grows_with_the_points(spark, monkeypatch):
    """Pairs scored, from the sizes of the groups of all rounds: linear, far from all pairs."""
    counts = {}
    real = D._scored
    for n in (500, 1000, 2000):
        seen = []

        def spy(groups, nodes, lists, size, dim):
            seen.append(groups.groupBy("v").count().agg(F.sum(F.col("count") ** 2)).first()[0])
            return real(groups, nodes, lists, size, dim)

        monkeypatch.setattr(D, "_scored", spy)
        ids, m = make(n, hot=False)
        hits = D.descent_top_k(frame(spark, ids, m[:, :6]), 3, size=6)
        assert share(hits, ids, m[:, :6], 3) > 0.9
        counts[n] = sum(seen) / n
    assert counts[2000] < 1.5 * counts[500]


def test_odd_points(spark):
    rows = [("a", [1.0, 0.0]), ("b", [0.0, 1.0]), ("c", None), ("d", []), ("e", [1.0]), ("f", [0.0, 0.0]), ("g", [None, 1.0]), ("a", [1.0, 0.1]),
            ("h", [0.0, 2.0])]
    points = spark.createDataFrame(rows, "id string, embedding array<float>").withColumns({"v": F.lit(1), "node": F.lit("x"), "nb": F.lit(2)})
    assert [r[:3] for r in shown(D.descent_top_k(points, 2))] == [
        ("a", 1, "a"), ("a", 2, "b"), ("b", 1, "b"), ("b", 2, "h"), ("h", 1, "b"), ("h", 2, "h")]
    assert D.descent_top_k(points.filter("false"), 2).count() == 0
    assert D.descent_top_k(points.filter("id = 'b'"), 2).count() == 1
    assert {(r.source, r.target) for r in G.descent_links(points, 1, keep_self=False).collect()} == {("a", "b"), ("b", "h"), ("h", "b")}


@pytest.mark.parametrize("folder", ["sf0.01", "sf0.1"])
def test_recall_on_given_vectors(spark, folder):
    d = f"/root/testdata/{folder}"
    found, truth = (QUERIES[name](spark, d).select("source", "target") for name in ("knn_descent", "knn_graph"))
    assert found.join(truth, ["source", "target"]).count() >= 0.95 * truth.count()


def test_a_bundle_gives_the_best_of_each_point(spark):
    """Many groups of the same points: what goes out is bounded by the list, not by the groups, and has the best."""
    ids, m = make(60, hot=False)
    nodes = frame(spark, ids, m)
    everyone = spark.range(40).select(F.concat(F.lit("g"), "id").alias("v")).crossJoin(nodes.select(F.col("id").alias("m"))).withColumn("fresh", F.lit(True))
    found = D._scored(everyone, nodes, None, 3, m.shape[1]).cache()
    assert found.groupBy("id").count().agg(F.max("count")).first()[0] <= 3 * 8
    best = D._best(found.withColumn("fresh", F.lit(True)), 3)
    near = {(q, n): i for q, n, i, _ in brute(ids, m, ids, m, 60)}
    truth = {(q, i) for q in ids for i in [near[q, n] for n in range(1, 61) if near[q, n] != q][:3]}
    assert {(r.id, r.nb) for r in best.collect()} == truth


def test_groups_without_a_new_member_are_left_out(spark):
    ids, m = make(6, hot=False)
    nodes = frame(spark, ids, m)
    rows = [("old", i, False) for i in ids[:3]] + [("new", i, i == ids[3]) for i in ids[2:]]
    found = D._scored(spark.createDataFrame(rows, "v string, m string, fresh boolean"), nodes, None, 5, m.shape[1])
    assert {(r.id, r.nb) for r in found.collect()} == {p for i in ids[2:] if i != ids[3] for p in ((i, ids[3]), (ids[3], i))}


def test_near_groups_are_bounded(spark, monkeypatch):
    monkeypatch.setattr(D, "NEAR_SIZE", 4, raising=False)
    ids, m = make(400, hot=False)
    m[:300] = m[0] + 1e-4 * m[:300]  # on the same side of nearly all planes
    groups = D.near_groups(frame(spark, ids, m), 400, 4, m.shape[1])
    assert tuples(groups.groupBy("m").count().select("count").distinct(), "count") == [(D.NEAR,)]
    assert groups.groupBy("v").count().agg(F.max("count")).first()[0] < 4 * 20


def test_a_vector_without_a_length_hides_no_other(spark):
    ids, m = make(30, hot=False)
    m[3:6, 0] = np.nan
    m[6, 0] = np.inf
    nodes = frame(spark, ids, m)
    groups = nodes.select(F.lit("g").alias("v"), F.col("id").alias("m"), F.lit(True).alias("fresh"))
    found = {(r.id, r.nb) for r in D._best(D._scored(groups, nodes, None, 2, m.shape[1]).withColumn("fresh", F.lit(True)), 2).collect()}
    fit = [n for n in range(30) if not 3 <= n <= 6]
    near = {(q, n): i for q, n, i, _ in brute([ids[n] for n in fit], m[fit], [ids[n] for n in fit], m[fit], 3)}
    assert found == {(ids[n], i) for n in fit for i in [near[ids[n], r] for r in (1, 2, 3)] if i != ids[n]}
