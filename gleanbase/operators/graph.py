"""The neighbour graph: nodes, links, expansion."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import values as v
from ..session import written
from .descent import descent_top_k
from .rows import ranked
from .similarity import CellIndex, approx_top_k, shown_score, top_k
from .skew import salted_join


def node_rows(points: DataFrame, raw: DataFrame | None = None) -> DataFrame:
    """Display nodes of (id, embedding, payload), with pictures from raw blocks."""
    fields = [
        "id",
        v.text_or(F.col("payload.title"), "Untitled").alias("title"),
        v.text_or(F.col("payload.description"), "No description").alias("description"),
        F.col("payload.source_url").alias("url"),
        *([F.col("embedding").alias("vector")] if "embedding" in points.columns else []),
    ]
    nodes = points.select(*fields)
    if raw is None:
        return nodes.withColumn("image", F.lit(None).cast("string")).withColumn("imageLarge", F.lit(None).cast("string"))
    pictures = raw.select(F.col("id").cast("string").alias("id"), F.col("image.square.url").alias("image"),
                          F.col("image.large.url").alias("imageLarge"))
    return nodes.join(pictures, "id", "left")


def links(hits: DataFrame, keep_self: bool = True, k: int | None = None) -> DataFrame:
    """Hits as links from the query to the hit. The query's own hit is a link too unless
    ``keep_self`` is off; ``k`` then cuts the rest to k per source."""
    kept = hits if keep_self else hits.filter(F.col("query_id") != F.col("id"))
    if k is not None:
        kept = kept.filter(F.col("rank") <= k) if keep_self else ranked(
            kept.drop("rank"), ["query_id"], [shown_score(F.col("score")).desc(), F.col("id")], k)
    return kept.select(F.col("query_id").alias("source"), F.col("id").alias("target"), F.col("score").alias("value"))


def neighbour_links(points: DataFrame, k: int = 10, keep_self: bool = True, of: DataFrame | None = None,
                    index: CellIndex | None = None, probes: int = 8) -> DataFrame:
    """Links of one expansion of every point, or of the points with the ids ``of``; exact, or
    by the ``probes`` nearest cells when an index is given."""
    asked = points if of is None else points.join(of.select("id").distinct(), "id", "left_semi")
    queries = asked.select(F.col("id").alias("query_id"), "embedding")
    most = k if keep_self else k + 1
    hits = top_k(queries, points, most) if index is None else approx_top_k(queries, index, most, probes)
    return links(hits, keep_self, k)


def descent_links(points: DataFrame, k: int = 10, keep_self: bool = True, size: int | None = None) -> DataFrame:
    """Links of one expansion of every point by neighbour descent: near to complete, with work
    linear in the points."""
    return links(descent_top_k(points, k if keep_self else k + 1, size), keep_self, k)


def new_nodes(existing: DataFrame, found: DataFrame) -> DataFrame:
    """Found nodes not in the graph yet, by id."""
    return found.join(existing.select("id"), "id", "left_anti")


def union_nodes(existing: DataFrame, found: DataFrame) -> DataFrame:
    return existing.unionByName(new_nodes(existing, found))


def append_links(existing: DataFrame, added: DataFrame, distinct: bool = False) -> DataFrame:
    """Links one after another; repeated links stay unless ``distinct``."""
    both = existing.unionByName(added)
    return both.dropDuplicates(["source", "target"]) if distinct else both


def expand_nodes(starts: DataFrame, points: DataFrame, k: int = 10, depth: int = 1, keep_self: bool = True,
                 index: CellIndex | None = None, probes: int = 8) -> DataFrame:
    """Links met when the nodes ``starts`` (id) are expanded and, hop after hop, the nodes
    that this brings in, as (source, target, value, hop). Only nodes of the frontier are
    searched, each once; ids without a point have no links."""
    frontier = written(starts.select("id").filter("id IS NOT NULL").distinct(), "frontier")
    done, out = frontier, None
    for hop in range(1, depth + 1):
        found = written(neighbour_links(points, k, keep_self, frontier, index, probes), "links").withColumn("hop", F.lit(hop))
        out = found if out is None else out.unionByName(found)
        if hop < depth:
            reached = found.select(F.col("target").alias("id")).distinct().join(done, "id", "left_anti")
            frontier = written(reached, "frontier")
            done = done.unionByName(frontier)
    return out


def expand(starts: DataFrame, edges: DataFrame, depth: int = 2) -> DataFrame:
    """Nodes reached from each start within ``depth`` expansions, with the first hop that
    reached them, as (start, id, hop). Each hop is written to the shared folder, so the
    plan does not grow with the depth and a lost executor costs one hop at most."""
    out = starts.select(F.col("id").alias("start"), "id").distinct().withColumn("hop", F.lit(0))
    seen = frontier = written(out, "hop")
    steps = edges.select(F.col("source").alias("id"), F.col("target").alias("_to"))
    for hop in range(1, depth + 1):
        # hubs are in many frontiers: their rows spread over the salts
        reached = salted_join(frontier.select("start", "id"), steps, "id", "inner", F.col("start"))
        fresh = reached.select("start", F.col("_to").alias("id")).distinct().join(
            seen.select("start", "id"), ["start", "id"], "left_anti").withColumn("hop", F.lit(hop))
        frontier = written(fresh, "hop")
        seen = seen.unionByName(frontier)
    return seen
