"""Neighbour lists of all points by descent: neighbours of neighbours are looked at in rounds.

Every point has a list of its best ``size`` points so far, at first those it met in groups
dealt by a hash and by sides of planes. In a round the lists and their reverse are joined: two points that are
neighbours of the same third are scored, if one of them is new there, and whoever is better
than the last of a list gets in. Rounds end when few entries change.

The work is linear in the points: a neighbourhood has ``size`` neighbours and at most as many
reverse ones (by a hash of the round, so that points many others name do not grow), and a
round scores no more than the pairs within it. Neighbourhoods are scored in bundles of bounded size,
to which a vector goes once. The answer is near to complete, not exact; a
larger ``size`` finds more, ``similarity.recall`` tells how much. Copies of a vector are one
point here and get their shares of the answer at the end, as in the exact search.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from . import similarity as S
from .rows import ranked
from .skew import salted_join, spread_join

SIZE = 24        # entries of a list, beyond those asked for
CHANGED = 0.002  # share of changed entries below which rounds end
DEALS = 2        # groups that each point is dealt to at first by a hash
NEAR = 12        # and groups of points on one side of planes,
NEAR_SIZE = 64   # these of so many points for each entry of a list
BUNDLE_BYTES = 300 << 20   # vectors of the groups that are scored by one task, at most
LEAST_BUNDLES = 8
PAIRS_AT_ONCE = 1_000_000  # pairs that a task holds before the best are kept


def neighbourhoods(lists: DataFrame, size: int, turn: int) -> DataFrame:
    """(v, m, fresh): the neighbours m of each v and the points that have v as one, of these
    at most ``size``; fresh if the entry is new since the round before."""
    back = ranked(lists.select(F.col("nb").alias("v"), F.col("id").alias("m"), "fresh"), ["v"],
                  [F.col("fresh").desc(), F.xxhash64(F.lit(turn), "m"), F.col("m")], size, "_n").drop("_n")
    both = lists.select(F.col("id").alias("v"), F.col("nb").alias("m"), "fresh").unionByName(back)
    return both.repartition("v").groupBy("v", "m").agg(F.max("fresh").alias("fresh"))


def near_groups(nodes: DataFrame, total: int, size: int, dim: int) -> DataFrame:
    """(v, m): every point in NEAR groups, with points on its side of some planes each time. A
    plane lies between two points drawn by lot; groups beyond the size aimed at are dealt by a hash."""
    most = NEAR_SIZE * (size + 1)
    bits = max(0, total // most - 1).bit_length()
    heads = np.nan_to_num(S._matrix(S._first_by_lot(nodes, total, 2 * NEAR * max(1, bits)).column("embedding"), dim))
    pairs = np.arange(2 * NEAR * bits).reshape(NEAR, bits, 2) % max(1, len(heads))
    planes = (heads[pairs[..., 0]] - heads[pairs[..., 1]]).reshape(NEAR * bits, dim)
    schema = T.StructType([T.StructField("v", T.LongType()), T.StructField("m", nodes.schema["id"].dataType)])

    def sides(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            over = (S._matrix(batch.column("embedding"), dim) @ planes.T > 0).reshape(batch.num_rows, NEAR, bits)
            codes = (over << np.arange(bits)).sum(axis=2, dtype=np.int64) * NEAR + np.arange(NEAR)
            rows = np.repeat(np.arange(batch.num_rows), NEAR)
            yield pa.RecordBatch.from_arrays([pa.array(codes.ravel()), batch.column("id").take(pa.array(rows))], ["v", "m"])

    sided = written(nodes.select("id", "embedding").mapInArrow(sides, schema), "sides")
    crowded = sided.groupBy("v").agg(F.ceil(F.count("*") / F.lit(most)).alias("parts")).filter("parts > 1")
    part = F.coalesce(F.pmod(F.xxhash64("v", "m"), F.col("parts")), F.lit(0))
    return spread_join(sided, crowded, "v", "left", F.col("m")).select(F.concat_ws("-", F.lit("near"), "v", part).alias("v"), "m")


class _Found:
    """The best ``size`` of each point, of the pairs met in a bundle. Points are numbers in
    the order of their ids; ``least`` is the score below which a pair cannot get in."""

    def __init__(self, least: np.ndarray, size: int):
        self.least, self.size, self.n = least, size, len(least)
        self.a, self.b, self.scores = np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)
        self.new: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        self.rows = 0

    def add(self, members: np.ndarray, fresh: np.ndarray, vectors: np.ndarray) -> None:
        product = vectors @ vectors.T
        use = product >= self.least[members][:, None]
        if not fresh.all():
            use &= fresh[:, None] | fresh[None, :]
        np.fill_diagonal(use, False)
        if len(members) > 2 * self.size:
            # what is shown as equal to the last of the best may come before it
            use &= product >= np.partition(product, -self.size - 1, axis=1)[:, -self.size - 1:][:, :1] - 2 * 10.0 ** -S.DIGITS
        x, y = np.nonzero(use)
        self.new.append((members[x], members[y], product[x, y]))
        self.rows += len(x)
        if self.rows > PAIRS_AT_ONCE:
            self.merge()

    def merge(self) -> None:
        a, b, scores = (np.concatenate(part) for part in zip((self.a, self.b, self.scores), *self.new))
        once = np.unique(a * self.n + b, return_index=True)[1]  # by a, then b
        a, b, scores = a[once], b[once], scores[once]
        keys = S._score_key(scores)
        order = np.lexsort((-keys, a))
        place = np.arange(len(a)) - np.searchsorted(a, a, "left")
        last = order[place == self.size - 1]
        self.least[a[last]] = np.maximum(self.least[a[last]], (keys[last] - 0.5) / 10.0 ** S.DIGITS - S._SCORE_SLACK)
        keep = order[place < self.size]
        self.a, self.b, self.scores = a[keep], b[keep], scores[keep]
        self.new, self.rows = [], 0


def _scored(groups: DataFrame, nodes: DataFrame, lists: DataFrame | None, size: int, dim: int) -> DataFrame:
    """(id, nb, score): pairs of members of one group (v, m, fresh), at least one of them
    fresh, where nb would get into the list of id; both ways. Groups are scored in bundles of
    bounded size: a vector goes once to a bundle, however many of its groups have it, and a
    bundle gives the best ``size`` of a point."""
    known = nodes.withColumn("last", F.lit(None).cast("double"))
    if lists is not None:
        last = lists.groupBy("id").agg(F.count("*").alias("n"), F.min("score").alias("last")).filter(F.col("n") >= size)
        known = nodes.join(last.select("id", "last"), "id", "left")
    # nothing is new in a group without a fresh member
    live = groups.withColumn("_any", F.max("fresh").over(Window.partitionBy("v"))).filter("_any")
    live = written(live.select("v", "m", "fresh"), "groups")
    bundles = max(LEAST_BUNDLES, -(-4 * dim * live.count() // BUNDLE_BYTES))
    dealt = live.withColumn("bundle", F.pmod(F.xxhash64("v"), F.lit(bundles)).cast("int"))
    # members of groups are several times the points, points may be any number: no side is broadcast by hand
    held = dealt.select("bundle", "m").distinct().join(known.withColumnRenamed("id", "m"), "m").select(
        "bundle", "m", "last", "embedding")
    id_type = nodes.schema["id"].dataType
    schema = T.StructType([T.StructField("id", id_type), T.StructField("nb", id_type), T.StructField("score", T.DoubleType())])
    names = [f.name for f in schema]

    def score(points: pa.Table, members: pa.Table) -> pa.Table:
        order = pc.sort_indices(points.column("m"))
        ids, row = points.column("m").take(order).combine_chunks(), order.to_numpy()
        least = points.column("last").fill_null(float("-inf")).to_numpy()[row] - S._SCORE_SLACK
        flat = points.column("embedding").combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, dim)
        members = members.take(pc.sort_indices(members, [("group", "ascending"), ("member", "ascending")]))
        at = pc.index_in(members.column("member").combine_chunks(), value_set=ids).to_numpy(zero_copy_only=False).astype(np.int64)
        fresh = members.column("fresh").to_numpy()
        group = members.column("group").combine_chunks().dictionary_encode().indices.to_numpy()
        ends = np.flatnonzero(np.diff(group, append=-1)) + 1
        found = _Found(least, size)
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            vectors = flat[row[at[start:end]]].astype(np.float64)
            with np.errstate(invalid="ignore"):
                vectors /= np.sqrt((vectors * vectors).sum(axis=1, keepdims=True))
            whole = np.isfinite(vectors).all(axis=1)
            found.add(at[start:end][whole], fresh[start:end][whole], vectors[whole])
        found.merge()
        return pa.table([ids.take(pa.array(found.a)), ids.take(pa.array(found.b)), pa.array(found.scores)], names)

    # other names, for both sides are of one table
    sent = dealt.select(F.col("bundle").alias("of"), F.col("v").alias("group"), F.col("m").alias("member"), "fresh")
    return held.groupBy("bundle").cogroup(sent.groupBy("of")).applyInArrow(score, schema)


def _best(pairs: DataFrame, size: int) -> DataFrame:
    """The best ``size`` of each id, each nb once; an entry is fresh unless an old row has it."""
    # rows of an id are few, ``size`` of each bundle: they are brought together once
    once = pairs.repartition("id").groupBy("id", "nb").agg(F.max("score").alias("score"), F.min("fresh").alias("fresh"))
    return ranked(once, ["id"], [S.score_key(F.col("score")).desc(), F.col("nb")], size, "_n").drop("_n")


def descend(nodes: DataFrame, size: int, dim: int, changed: float = CHANGED, rounds: int = 50) -> DataFrame:
    """(id, nb, score): the lists of distinct vectors ``nodes`` (id, embedding), a written table."""
    total = nodes.count()
    deals = max(1, -(-total // (size + 1)))
    dealt = nodes.select("id", F.explode(F.sequence(F.lit(1), F.lit(DEALS))).alias("deal"))
    groups = dealt.select(F.concat_ws("-", "deal", F.pmod(F.xxhash64("deal", "id"), F.lit(deals))).alias("v"), F.col("id").alias("m"))
    groups = groups.unionByName(near_groups(nodes, total, size, dim)).withColumn("fresh", F.lit(True))
    lists = written(_best(_scored(groups, nodes, None, size, dim).withColumn("fresh", F.lit(True)), size), "lists")
    for turn in range(rounds):
        found = _scored(neighbourhoods(lists, size, turn), nodes, lists, size, dim).withColumn("fresh", F.lit(True))
        lists = written(_best(lists.withColumn("fresh", F.lit(False)).unionByName(found), size), "lists")
        if lists.filter("fresh").count() <= changed * total * size:
            break
    return lists.select("id", "nb", "score")


def descent_top_k(points: DataFrame, k: int = 10, size: int | None = None, changed: float = CHANGED) -> DataFrame:
    """(query_id, rank, id, score): the best k found for every point of ``points`` (id,
    embedding), itself among them. ``size`` is that of the lists, k + SIZE by default. Points of
    another dimension than most, with a null or without a direction have no hits; rows that
    repeat an id are one point, that with the least vector."""
    dim, _ = S.common_dimension(points)
    fit = S._usable(points.select("id", "embedding"), "embedding", dim).filter(F.exists("embedding", lambda x: x != 0))
    once = fit.groupBy("id").agg(F.min("embedding").alias("embedding")).withColumn("_fp", S._fingerprint(F.col("embedding")))
    once = written(once, "points")
    firsts = once.groupBy("_fp").agg(F.min("id").alias("node"))
    asked = written(once.join(firsts, "_fp").select("node", "id", (F.col("id") == F.col("node")).alias("first")), "asked")
    nodes = written(once.join(asked.filter("first").select("id"), "id").select("id", "embedding"), "nodes")
    lists = descend(nodes, size or k + SIZE, dim, changed)
    members = ranked(asked.select("node", "id"), ["node"], [F.col("id")], k, "_n").drop("_n")
    near = lists.select(F.col("id").alias("query_id"), F.col("nb").alias("node"), "score").unionByName(
        nodes.select(F.col("id").alias("query_id"), F.col("id").alias("node"), F.lit(1.0).alias("score")))
    # k copies of each of a few points: at most k of them are in an answer
    hits = written(S.best_k(near.join(members, "node").select("query_id", "id", "score"), k), "hits")
    answered = hits.withColumnRenamed("query_id", "node")
    return salted_join(asked.select("node", F.col("id").alias("query_id")), answered, "node", "inner", F.col("query_id")).select(
        "query_id", "rank", "id", "score")
