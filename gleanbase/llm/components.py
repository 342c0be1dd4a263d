"""Connected components by alternating stars, one written table per round."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written


def _large(edges: DataFrame) -> DataFrame:
    """Each node hangs its larger neighbours on the least of its neighbourhood."""
    both = edges.select("u", "v").union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m"))
    return (both.join(least, "u").filter("v > u")
            .select(F.col("v").alias("u"), F.least("u", "m").alias("v")).distinct())


def _small(edges: DataFrame) -> DataFrame:
    """Each node hangs its smaller neighbours and itself on the least of them."""
    least = edges.groupBy("u").agg(F.min("v").alias("m"))
    hung = edges.join(least, "u").filter("v != m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return hung.union(least.select("u", F.col("m").alias("v"))).distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) of every node with an edge, root being the least node reachable.

    ``edges`` has two long columns. Aggregates are combined before each shuffle and a node
    never holds its neighbours in one row, so stars of any size are fine. Loops, repeated
    edges and edges with a null end change nothing.
    """
    u, v = edges.columns
    state = written(edges.select(F.greatest(u, v).alias("u"), F.least(u, v).alias("v"))
                    .filter(F.col(u).isNotNull() & F.col(v).isNotNull()).filter("u != v").distinct(), "edges")

    def mark(df: DataFrame):
        return df.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()

    before = mark(state)
    while before[0]:
        state = written(_small(_large(state)), "edges")
        after = mark(state)
        if after == before:
            break
        before = after
    roots = state.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct()
    return state.select(F.col("u").alias("node"), F.col("v").alias("root")).union(roots)
