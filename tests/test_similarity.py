import numpy as np
import pytest
from helpers import tuples
from pyspark.sql import functions as F

from gleanbase.operators import similarity as S
from gleanbase.operators import tree as R
from gleanbase.operators.embed import HashEncoder, embed
from gleanbase.operators.search import enrich, search_text, search_vectors

DIM = 12


def make(n=400, seed=1, hot=True):
    """Vectors of which a third are one copied vector, some near copies of it, one zero."""
    rng = np.random.default_rng(seed)
    m = rng.normal(size=(n, DIM)).astype(np.float32)
    if hot:
        m[: n // 3] = m[0]
        m[n // 3: n // 2] = m[0] + rng.normal(scale=0.02, size=(n // 2 - n // 3, DIM))
        m[-1] = 0
    return [f"p{i:04d}" for i in range(n)], m


def frame(spark, ids, m):
    rows = [(i, [float(x) for x in v]) for i, v in zip(ids, m)]
    return spark.createDataFrame(rows, "id string, embedding array<float>").repartition(5)


def brute(qids, q, ids, p, k):
    def unit(x):
        x = x.astype(np.float64)
        return x / np.linalg.norm(x, axis=1, keepdims=True)
    out = []
    with np.errstate(invalid="ignore"):
        scores = np.round(unit(q) @ unit(p).T, 4) + 0.0
    for name, row in zip(qids, scores):
        pairs = sorted((-s, i) for s, i in zip(row, ids) if np.isfinite(s))[:k]
        out += [(name, r + 1, i, -s + 0.0) for r, (s, i) in enumerate(pairs)]
    return sorted(out, key=repr)


def shown(hits):
    return tuples(hits.withColumn("score", S.shown_score(F.col("score"))), "query_id", "rank", "id", "score")


@pytest.mark.parametrize("way", ["scan", "tree", "tree of small blocks"])
def test_exact_equals_brute_force(spark, monkeypatch, way):
    ids, m = make()
    points = frame(spark, ids, m)
    queries = points.withColumnRenamed("id", "query_id")
    if way == "scan":
        got = S.top_k(queries, points, 5)
    else:
        if "small" in way:
            monkeypatch.setattr(R, "LEAF", 20)
            monkeypatch.setattr(R, "BLOCK", 15)
        monkeypatch.setattr(S, "SCAN_QUERIES", 10)
        got = S.top_k(queries, points, 5)
    assert shown(got) == brute(ids, m, ids, m, 5)


def test_fewer_points_than_k_and_odd_vectors(spark):
    ids, m = make(6, hot=False)
    points = frame(spark, ids, m).unionByName(spark.createDataFrame(
        [("short", [1.0]), ("none", None), ("hole", [1.0] * (DIM - 1) + [None]), ("zero", [0.0] * DIM)], "id string, embedding array<float>"))
    queries = points.withColumnRenamed("id", "query_id")
    want = brute(ids, m, ids, m, 10)
    assert shown(S.top_k(queries, points, 10)) == want
    assert shown(S.approx_top_k(queries, S.build_index(points, 10), 10, probes=10)) == want


def test_approximate_recall(spark, sf):
    points = spark.read.parquet(f"{sf}/embeddings.parquet").select(F.col("vec_id").alias("id"), "embedding")
    queries = points.withColumnRenamed("id", "query_id")
    index = S.build_index(points, 5)
    truth = S.top_k(queries, points, 5)
    some = S.recall(S.approx_top_k(queries, index, 5, probes=12), truth).first()[0]
    assert some >= 0.8
    assert S.recall(S.approx_top_k(queries, index, 5, probes=len(index.pivots)), truth).first()[0] == 1.0


def test_hash_encoder():
    e = HashEncoder(16)(["b a a", "", "A a B", "ß é ١"])
    assert np.allclose(np.linalg.norm(e, axis=1), [1, 0, 1, 1]) and np.allclose(e[0], e[2])


def test_text_search_with_another_encoder(spark):
    class Stub:
        """Stands for a model: vowel counts."""

        def __call__(self, texts):
            return np.array([[t.count(v) + 0.1 for v in "aeiou"] for t in texts], dtype=np.float32).reshape(-1, 5)

    blocks = spark.createDataFrame([("1", "aaa", "A"), ("2", "eee", None), ("3", "aea", "C")], "id string, crawled_text string, title string")
    points = embed(blocks, make_encoder=Stub, dim=5).select("id", "embedding", F.struct(
        F.col("id").alias("block_id"), "title", F.lit("d").alias("description"), F.lit("u").alias("source_url"), F.col("crawled_text").alias("text_preview")).alias("payload"))
    asked = spark.createDataFrame([(1, "a"), (2, "e e")], "query_id long, question string")
    hits = search_text(asked, points, 2, Stub, 5)
    assert tuples(hits, "query_id", "rank", "block_id", "title") == [(1, 1, "1", "A"), (1, 2, "3", "C"), (2, 1, "2", None), (2, 2, "3", "C")]
    with_vector = search_vectors(points.select(F.col("id").alias("query_id"), "embedding"), points, 1, with_vector=True)
    assert tuples(with_vector, "query_id", "id") == [("1", "1"), ("2", "2"), ("3", "3")] and "embedding" in with_vector.columns
    full = spark.createDataFrame([("1", "x")], "id string, more string")
    for few in (True, False):
        assert tuples(enrich(hits, full, few), "query_id", "rank", "more") == [(1, 1, "x"), (1, 2, None), (2, 1, None), (2, 2, None)]


@pytest.mark.parametrize("scan", [4096, 0])
def test_both_ways_keep_one_contract(spark, monkeypatch, scan):
    """Scores on a rounding boundary, queries that repeat an id, mixed dimensions."""
    monkeypatch.setattr(S, "SCAN_QUERIES", scan)
    ones, near = [1.0] * 1024, [1.0] * 1024
    query = [1.0] + [0.0] * 1023  # its cosine with ``ones`` is 0.03125 exactly
    near[0] = 1.0013
    points = spark.createDataFrame(
        [("b", near), ("a", ones), ("c", [0.0] * 1023 + [1.0]), ("short", [1.0, 2.0])], "id string, embedding array<float>")
    queries = spark.createDataFrame(
        [("q", query), ("twice", query), ("twice", ones), ("two", [1.0, 1.0]), ("three", [1.0, 1.0]), ("four", [1.0, 0.0])],
        "query_id string, embedding array<float>")
    two = tuples(S.top_k(queries, points, 2), "query_id", "rank", "id")
    assert two == [("q", 1, "a"), ("q", 2, "b"), ("twice", 1, "a"), ("twice", 2, "b")]
    assert tuples(S.top_k(queries, points, 1), "query_id", "rank", "id") == [r for r in two if r[1] == 1]


def tasks_run(spark, job):
    """Tasks of all stages that ``job`` starts."""
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("counted", "counted")
    job()
    ids = tracker.getJobIdsForGroup("counted")
    spark.sparkContext._jsc.clearJobGroup()
    return sum(tracker.getStageInfo(s).numTasks for j in ids for s in tracker.getJobInfo(j).stageIds if tracker.getStageInfo(s))


def test_too_many_queries_are_noticed_without_a_full_scan(spark, monkeypatch):
    monkeypatch.setattr(S, "SCAN_QUERIES", 10)
    queries = spark.range(4000, numPartitions=40).select(
        F.col("id").alias("query_id"), F.array(F.lit(1.0).cast("float")).alias("embedding"))
    assert tasks_run(spark, lambda: S.small_queries(queries, 5)) < 10


@pytest.mark.parametrize("n,rows", [(5, 4000), (5, 10 ** 7), (5000, 4000)])
def test_pivots_are_the_first_by_lot(spark, n, rows):
    """Whether the threshold lets enough through at once, too few, or all."""
    points = spark.range(4000, numPartitions=40).select("id", F.array(F.col("id").cast("float")).alias("embedding"))
    want = [r[0] for r in points.orderBy(F.md5(F.col("id").cast("string")), "id").limit(n).select("embedding").collect()]
    assert S._first_by_lot(points, rows, n).column("embedding").to_pylist() == want


def test_index_opened_again(spark):
    from gleanbase.session import scratch_path
    ids, m = make(200)
    points, path = frame(spark, ids, m), scratch_path(spark, "index")
    made, again = S.build_index(points, 3, path=path), S.open_index(spark, path)
    assert np.array_equal(made.pivots, again.pivots) and made.stats == again.stats and again.k_max == 3
    queries = points.withColumnRenamed("id", "query_id")
    assert shown(S.approx_top_k(queries, again, 3, probes=len(again.pivots))) == brute(ids, m, ids, m, 3)
    empty = S.build_index(points.limit(0), 3)
    assert S.approx_top_k(queries, empty, 3).count() == 0


def test_pairs_ruled_out_in_single_precision_are_few_and_never_a_hit():
    from gleanbase.operators import similarity as S
    rng = np.random.default_rng(8)
    points = rng.normal(size=(6000, 24))
    points[50:90] = points[50]  # ties at the k-th place
    points /= np.sqrt((points * points).sum(axis=1, keepdims=True))
    ids = np.array([f"p{n:05d}" for n in rng.permutation(6000)])
    best = S._Best(points[:100], 7)
    assert sum(len(r) for r, _ in best._may(points[:40], points)) < 40 * 6000 / 50
    best.add(ids[:3500], points[:3500])
    best.add(ids[3500:], points[3500:])
    keys = S._score_key(points[:100] @ points.T)
    want = {(q, ids[n]) for q in range(100) for n in np.lexsort((ids, -keys[q]))[:7]}
    assert {(int(q), i) for q, i in zip(best.rows, best.ids)} == want
