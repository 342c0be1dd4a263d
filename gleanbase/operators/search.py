"""Searches that answer with payloads and full blocks."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .embed import DIM, Encoder, HashEncoder, embed
from .similarity import CellIndex, approx_top_k, scan_top_k, small_queries, top_k
from .skew import salted_join

# Hits asked for by the callers.
TEXT_SEARCH_K = 5
RETRIEVE_K = 3
VECTOR_SEARCH_K = 10
FIRST_SAMPLE = 20


def enrich(hits: DataFrame, blocks: DataFrame, few: bool = False) -> DataFrame:
    """Left join of the full block to every hit; a hit without one keeps nulls. ``few``
    says that the hits should be few: the blocks are then cut down to them before the join,
    in place if Spark finds the ids small enough to broadcast. Otherwise a hub block may be in a large share of the hits and is
    spread."""
    if few:
        wanted = hits.select("id").distinct()
        return hits.join(blocks.join(wanted, "id", "left_semi"), "id", "left")
    return salted_join(hits, blocks, "id", "left", F.col("query_id"))


def with_payload(hits: DataFrame, points: DataFrame, few: bool = False) -> DataFrame:
    """Payload fields of the hits. ``few`` says that the hits are known to be few; then
    they go to the points and the points stay where they are."""
    carried = points.select("id", "payload")
    if few:
        found = carried.join(F.broadcast(hits), "id")
    else:
        found = salted_join(hits, carried, "id", "inner", F.col("query_id"))
    return found.select("query_id", "rank", "id", "score", "payload.*")


def search_vectors(queries: DataFrame, points: DataFrame, k: int = VECTOR_SEARCH_K,
                   index: CellIndex | None = None, probes: int = 8, with_vector: bool = False) -> DataFrame:
    """k nearest points of each query vector (query_id, embedding); exact, or by the
    ``probes`` nearest cells when an index is given. A query that is itself a point
    finds itself."""
    few = None
    if index is not None:
        hits = approx_top_k(queries, index, k, probes)
    else:
        few = small_queries(queries, k)
        hits = top_k(queries, points, k) if few is None else scan_top_k(
            few, queries.schema["query_id"].dataType, points, k)
    out = with_payload(hits, points, few is not None)
    if with_vector:
        out = salted_join(out, points.select("id", "embedding"), "id", "left", F.col("query_id"))
    return out


def search_text(questions: DataFrame, points: DataFrame, k: int = TEXT_SEARCH_K,
                make_encoder: Callable[[], Encoder] = HashEncoder, dim: int = DIM,
                text: str = "question", index: CellIndex | None = None, probes: int = 8) -> DataFrame:
    """Embed each text of (query_id, text) and search with it."""
    asked = embed(questions.select("query_id", text), text, make_encoder, dim).select("query_id", "embedding")
    return search_vectors(asked, points, k, index, probes)
