"""Exact top-k of any number of queries, by a tree of pivots with bounded leaves.

The points of a node are dealt to its nearest pivot, points of the node taken by lot, until no
node has more than ``leaf`` vectors; pivots, bounds and leaves are tables, so no task holds
more than one node's pivots whatever the size of the whole. The lots are drawn anew on every level, and a
node that got more than half of its parent's vectors is dealt out evenly, whatever the angles: so two levels
halve a node at least, and a vector that is nearest to all others makes no tree of endless depth. A query goes down to the leaf
nearest to it and is scored there. Then it goes down again, to all children that the angle
bounds cannot rule out against the k-th score it has, level by level; visits are pairs of a
query and a node, and vectors join them only where they are compared. A node of no more than
``bundle`` vectors is visited as a whole, and its leaves are ruled out within the task: so
visits and hits grow with the bundles, however small the leaves. Every answer is that of
comparing all pairs, in the order of ``similarity``.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, written
from . import similarity as S
from .rows import ranked

FAN = 64     # children of a node at most
LEAF = 8192  # distinct vectors of a leaf at most
BUNDLE = 32_768          # vectors of the leaves visited together at most (a larger leaf is visited alone),
BUNDLE_BYTES = 32 << 20  # in no more than this
_ALIKE = 1e-12
BLOCK = 8192  # vectors dealt to pivots, or queries of a node, at once


@dataclass
class TreeIndex:
    """``leaves``: (top, cell, ids, embedding), each distinct vector once with its first k_max ids;
    ``top`` is the node that its leaf is visited with. ``levels``: for each level the children of
    its nodes, (parent, cell, pivot, low, high, inside), low and high being the least and greatest
    angle of a vector of the child to its pivot; inside if the parent is visited as a whole, as all
    are from level ``depth`` on."""

    leaves: DataFrame
    levels: list[DataFrame]
    dim: int
    k_max: int
    depth: int


def _lots(of: Column | str, count: Column) -> Column:
    return F.pmod(F.xxhash64(of), F.ceil(count / BLOCK)).cast("int")


def _every(count: Column) -> Column:
    return F.explode(F.sequence(F.lit(0), F.ceil(count / BLOCK).cast("int") - 1))


def build_tree(points: DataFrame, k_max: int = 10, leaf: int | None = None, fan: int = FAN, path: str | None = None) -> TreeIndex:
    """Write the tree of (id, embedding). Vectors of another dimension than most, with a null
    or without a direction are left out; of copies the k_max lowest ids are kept."""
    spark, leaf = points.sparkSession, leaf or LEAF
    path = path or scratch_path(spark, "tree")
    dim, _ = S.common_dimension(points)
    whole = S._usable(points.select("id", "embedding"), "embedding", dim).filter(F.exists("embedding", lambda x: x != 0))
    few = ranked(whole.withColumn("fp", S._fingerprint(F.col("embedding"))), ["fp"], [F.col("id")], k_max, "_n")
    state = written(few.groupBy("fp").agg(F.sort_array(F.collect_list("id")).alias("ids"), F.first("embedding").alias("embedding"))
                    .select(F.lit(0).cast("long").alias("cell"), F.lit(None).cast("long").alias("top"), "fp", "ids", "embedding",
                            F.lit(None).cast("long").alias("was")), "vectors")
    bundle = max(leaf, min(BUNDLE, BUNDLE_BYTES // (8 * dim)))
    level = depth = used = 0
    while True:
        counts = written(state.groupBy("cell").agg(F.count("*").alias("n"), F.coalesce(F.count("*") > F.max("was") / 2, F.lit(False)).alias("even")), "counts")
        big = counts.filter(F.col("n") > leaf)
        most = counts.agg(F.max("n")).first()[0] or 0
        state = state.drop("was").join(counts.select("cell", "n"), "cell").withColumn("top", F.coalesce("top", F.when(F.col("n") <= bundle, F.col("cell")))).drop("n")
        done = state.join(big.select("cell"), "cell", "left_anti").select("top", "cell", "ids", "embedding")
        done.hint("rebalance", "cell").sortWithinPartitions("cell").write.parquet(f"{path}/leaves/level={level}")
        if most <= leaf:
            break
        inner = state.join(big, "cell").withColumn("lot", _lots("fp", F.col("n")))
        # no more children than make leaves, or bundles, of half the size that they may have
        wanted = F.ceil(2 * F.col("n") / F.when(F.col("n") > bundle, F.lit(bundle)).otherwise(F.lit(leaf)))
        heads = ranked(inner, ["cell"], [F.md5(F.concat(F.lit(f"{level}:"), "fp")), F.col("fp")], fan, "_n").filter(F.col("_n") <= F.greatest(wanted, F.lit(4))).select(
            "cell", "n", "even", (F.lit(used + 1) + F.monotonically_increasing_id()).alias("child"), F.col("embedding").alias("pivot"))
        heads = written(heads, "pivots")
        used = heads.agg(F.max("child")).first()[0]  # numbers do not grow with the depth as those of paths would

        def deal(held: pa.Table, pivots: pa.Table) -> pa.Table:
            cosine = S._matrix(held.column("embedding"), dim) @ S._matrix(pivots.column("pivot"), dim).T
            # of pivots in one direction, which no angle tells apart, each gets its share by hash
            alike = cosine >= cosine.max(axis=1, keepdims=True) - _ALIKE
            lot = np.array([int(md5(f"{level}:{fp}".encode()).hexdigest()[:8], 16) for fp in held.column("fp").to_pylist()])
            if pivots.column("even")[0].as_py():
                nearest = np.argsort(np.argsort(lot, kind="stable")) % pivots.num_rows
            else:
                nearest = (np.cumsum(alike, axis=1) > (lot % alike.sum(axis=1))[:, None]).argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(nearest)), nearest], -1, 1))
            cells = pivots.column("child").combine_chunks().take(pa.array(nearest))
            was = pivots.column("n").combine_chunks().take(pa.array(nearest))
            return pa.table([cells, *(held.column(c) for c in ("top", "fp", "ids", "embedding")), was, pa.array(angle)],
                            ["cell", "top", "fp", "ids", "embedding", "was", "angle"])

        dealt = written(inner.select("cell", "lot", "top", "fp", "ids", "embedding").groupBy("cell", "lot").cogroup(
            heads.withColumn("lot", _every(F.col("n"))).select("cell", "lot", "n", "even", "child", "pivot").groupBy("cell", "lot")).applyInArrow(
                deal, _schema(state, "was long", "angle double")), "dealt")
        bounds = dealt.groupBy(F.col("cell").alias("child")).agg(F.min("angle").alias("low"), F.max("angle").alias("high"))
        heads.join(bounds, "child").select(F.col("cell").alias("parent"), F.col("child").alias("cell"), "pivot", "low", "high", (
            F.col("n") <= bundle).alias("inside")).write.parquet(f"{path}/nodes/level={level}")
        state, level = dealt.drop("angle"), level + 1
        depth = level if most > bundle else depth
    spark.createDataFrame([(dim, k_max, level, depth)], "dim int, k_max int, levels int, depth int").coalesce(1).write.parquet(f"{path}/shape")
    return open_tree(spark, path)


def _schema(df: DataFrame, *more: str) -> str:
    return ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in df.schema), *more])


def open_tree(spark: SparkSession, path: str) -> TreeIndex:
    """The tree that ``build_tree`` wrote at ``path``, for any number of sessions."""
    shape = spark.read.parquet(f"{path}/shape").first()
    levels = [spark.read.parquet(f"{path}/nodes/level={n}") for n in range(shape["levels"])]
    return TreeIndex(spark.read.parquet(f"{path}/leaves").drop("level"), levels, shape["dim"], shape["k_max"], shape["depth"])


def _down(visits: DataFrame, queries: DataFrame, nodes: DataFrame, dim: int, all_that_may: bool) -> DataFrame:
    """Visits (query_id, cell) of one level's nodes as visits of their children: the nearest, or
    all that the bounds cannot rule out against ``least`` of the query."""
    asked = visits.groupBy("cell").agg(F.count("*").alias("asked"))
    here = nodes.select(F.col("parent").alias("cell"), F.col("cell").alias("child"), "pivot", "low", "high").join(asked, "cell")
    lhs = visits.join(asked.join(nodes.select(F.col("parent").alias("cell")).distinct(), "cell"), "cell").withColumn(
        "lot", _lots("query_id", F.col("asked"))).join(queries, "query_id")
    kind = queries.schema["query_id"].dataType.simpleString()
    arrow = pa.schema([("query_id", S._arrow(queries.schema["query_id"].dataType)), ("cell", pa.int64())])

    def choose(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return arrow.empty_table()
        angles = np.arccos(np.clip(S._matrix(asking.column("embedding"), dim) @ S._matrix(held.column("pivot"), dim).T, -1, 1))
        if all_that_may:
            low, high = (S._values(held.column(c)) for c in ("low", "high"))
            gap = np.maximum(np.maximum(angles - high, low - angles) - S._ANGLE_SLACK, 0)
            least = asking.column("least").to_numpy()
            least = np.where(np.isnan(least), -np.inf, least)
            rows, cols = np.nonzero(np.cos(gap) >= least[:, None] - S._SCORE_SLACK)
        else:
            rows, cols = np.arange(len(angles)), angles.argmin(axis=1)
        return pa.table([asking.column("query_id").take(pa.array(rows)), held.column("child").take(pa.array(cols))], schema=arrow)

    return lhs.select("cell", "lot", "query_id", "embedding", "least").groupBy("cell", "lot").cogroup(
        here.withColumn("lot", _every(F.col("asked"))).select("cell", "lot", "child", "pivot", "low", "high").groupBy("cell", "lot")
    ).applyInArrow(choose, f"query_id {kind}, cell long")


def _visited(queries: DataFrame, tree: TreeIndex, all_that_may: bool) -> DataFrame:
    """(query_id, cell) of the nodes visited as a whole that the queries (query_id, embedding, least) go down to.
    Each level is written: its visits are the input of the next and, where a node has no
    children, of the scoring."""
    at = written(queries.select("query_id", F.lit(0).cast("long").alias("cell")), "visits")
    out = []
    for nodes in (level.filter("NOT inside") for level in tree.levels[:tree.depth]):
        out.append(at.join(nodes.select(F.col("parent").alias("cell")).distinct(), "cell", "left_anti").select("query_id", "cell"))
        at = written(_down(at, queries, nodes, tree.dim, all_that_may), "visits")
    for part in out:
        at = at.unionByName(part)
    return at


def _may_hold(queries: np.ndarray, least: np.ndarray, vectors: np.ndarray, leaves: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Queries and vectors to compare, by their places: leaf by leaf, or all at once where the angles
    to the middles of the leaves rule out less than half."""
    starts = np.flatnonzero(np.r_[True, leaves[1:] != leaves[:-1]])
    if len(starts) > 1 and np.isfinite(least).any():
        ends = np.r_[starts[1:], len(leaves)]
        middles = np.add.reduceat(vectors, starts)
        length = np.sqrt((middles * middles).sum(axis=1, keepdims=True))
        middles = np.divide(middles, length, out=np.zeros_like(middles), where=length > 0)
        far = np.minimum.reduceat(np.einsum("ij,ij->i", vectors, np.repeat(middles, ends - starts, axis=0)), starts)
        gap = np.arccos(np.clip(queries @ middles.T, -1, 1)) - np.arccos(np.clip(far, -1, 1)) - S._ANGLE_SLACK
        # a middle without a direction rules out nothing
        may = (np.cos(np.maximum(gap, 0)) >= least[:, None] - S._SCORE_SLACK) | (length[:, 0] == 0)
        if may.mean() < 0.5:
            for n, (start, end) in enumerate(zip(starts, ends)):
                if may[:, n].any():
                    yield np.flatnonzero(may[:, n]), np.arange(start, end)
            return
    yield np.arange(len(queries)), np.arange(len(vectors))


def _scored(visits: DataFrame, queries: DataFrame, tree: TreeIndex, k: int) -> DataFrame:
    """(query_id, id, score): the best k of each query (query_id, embedding, least) in the leaves
    it may need of each node it visits."""
    id_type = tree.leaves.schema["ids"].dataType.elementType
    schema, dim = S._hit_schema(queries.schema["query_id"].dataType, id_type), tree.dim
    arrow = S._hit_arrow(schema)
    asked = written(visits.groupBy("cell").agg(F.count("*").alias("asked")), "asked")
    lhs = visits.join(asked, "cell").withColumn("lot", _lots("query_id", F.col("asked"))).join(
        queries.select("query_id", "embedding", "least"), "query_id")
    rhs = tree.leaves.select(F.col("top").alias("cell"), F.col("cell").alias("leaf"), "ids", "embedding").join(asked, "cell").withColumn(
        "lot", _every(F.col("asked")))

    def score(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return arrow.empty_table()
        held = held.sort_by("leaf")
        names, ids = S._values(asking.column("query_id")), held.column("ids").combine_chunks()
        sizes = ids.value_lengths().to_numpy(zero_copy_only=False)
        first = np.cumsum(sizes) - sizes
        ids = S._values(ids.flatten())
        queries_, vectors = S._matrix(asking.column("embedding"), dim), S._matrix(held.column("embedding"), dim)
        least = asking.column("least").to_numpy()
        least = np.where(np.isnan(least), -np.inf, least)
        out = []
        for some, of in _may_hold(queries_, least, vectors, S._values(held.column("leaf"))):
            best = S._Best(queries_[some], k)
            copies = np.repeat(of, sizes[of])
            places = np.arange(len(copies)) - np.repeat(np.cumsum(sizes[of]) - sizes[of], sizes[of])
            best.add(ids[first[copies] + places], vectors[copies])
            out.append(best.table(names[some], arrow))
        return pa.concat_tables(out) if out else arrow.empty_table()

    return lhs.select("cell", "lot", "query_id", "embedding", "least").groupBy("cell", "lot").cogroup(
        rhs.select("cell", "lot", "leaf", "ids", "embedding").groupBy("cell", "lot")).applyInArrow(score, schema)


def tree_top_k(queries: DataFrame, tree: TreeIndex, k: int = 10) -> DataFrame:
    """(query_id, rank, id, score): the exact best k of all points of the tree for each of
    ``queries`` (query_id, embedding), each id once."""
    if k > tree.k_max:
        raise ValueError(f"the tree keeps {tree.k_max} copies of a vector; k may not exceed it")

    def answer(distinct: DataFrame) -> DataFrame:
        fit = S._usable(distinct, "embedding", tree.dim).filter(F.exists("embedding", lambda x: x != 0))
        plain = fit.withColumn("least", F.lit(None).cast("double"))
        own = _visited(plain, tree, False)
        first = written(S.best_k(_scored(own, plain, tree, k), k), "own-leaf")
        # the k-th shown score; with fewer than k points so far nothing is ruled out
        bound = first.filter(F.col("rank") == k).select("query_id", S.shown_score(F.col("score")).alias("least"))
        bounded = written(fit.join(bound, "query_id", "left"), "bounded")
        rest = _visited(bounded, tree, True).join(own, ["query_id", "cell"], "left_anti")
        second = _scored(written(rest, "visits"), bounded, tree, k)
        return S.best_k(first.select("query_id", "id", "score").unionByName(second), k)

    return S._once_per_vector(S.one_per_id(queries), answer)
