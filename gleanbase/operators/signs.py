"""Approximate top-k by signs of random projections, in several tables, verified by score.

The signs of a vector's products with ``bits`` planes are its signature; vectors at a small
angle agree in most signs. Each of ``tables`` tables has its own planes. A query looks into the
bucket of its own signature in each table and into those at up to ``flips`` signs from it
(multi-probe); who meets it there is scored exactly. A query that finds fewer hits than there
could be is asked again with one flip more, up to all signs, so answers are never short.

Plane entries are 1 or -1 by a hash of their place, so any session and any other engine has
the same planes. Choose ``bits`` so that a bucket holds some hundreds of points (the binary
logarithm of rows / 500), then ``tables`` and ``flips`` by ``recall``; every point is stored
once per table. Buckets are scored in blocks of bounded size on both sides.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from hashlib import md5
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, written
from . import similarity as S
from .rows import ranked

TABLES, BITS, FLIPS = 10, 6, 1
POINT_BYTES, QUERY_BYTES = 16 << 20, 32 << 20  # vectors of a scoring block, in doubles


@dataclass
class SignIndex:
    """Points (tbl, sig, id, embedding) by bucket, and the size of each bucket: (tbl, sig, n)."""

    buckets: DataFrame
    sizes: DataFrame
    dim: int
    tables: int
    bits: int
    k_max: int


def planes(dim: int, tables: int, bits: int) -> np.ndarray:
    """Planes of all tables: tables x bits x dim entries, 1 where the first 32 bits of the md5 of
    "table-bit-dim" are an odd number, else -1."""
    odd = [int(md5(f"{t}-{b}-{d}".encode()).hexdigest()[7], 16) & 1 for t in range(tables) for b in range(bits) for d in range(dim)]
    return np.where(odd, 1.0, -1.0).reshape(tables, bits, dim)


def _signatures(vectors: np.ndarray, planes: np.ndarray) -> np.ndarray:
    """Row by table: the signs as a number, bit b for plane b."""
    tables, bits, dim = planes.shape
    signs = (vectors @ planes.reshape(-1, dim).T > 0).reshape(-1, tables, bits)
    return signs @ (1 << np.arange(bits))


def build_signs(points: DataFrame, k_max: int = 10, tables: int = TABLES, bits: int = BITS, path: str | None = None) -> SignIndex:
    """Write the index of (id, embedding). Of equal vectors, which no plane could part, the
    k_max lowest ids are kept; vectors of another dimension than most, with a null or without
    a direction are left out, as in the exact search."""
    spark = points.sparkSession
    path = path or scratch_path(spark, "signs")
    dim, _ = S.common_dimension(points)
    whole = S._usable(points.select("id", "embedding"), "embedding", dim).filter(F.exists("embedding", lambda x: x != 0))
    clean = ranked(whole.withColumn("_fp", S._fingerprint(F.col("embedding"))), ["_fp"], [F.col("id")], k_max, "_n").drop("_fp", "_n")
    shared = spark.sparkContext.broadcast(planes(dim, tables, bits))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _signatures(batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim),
                                shared.value)
            for t in range(tables):
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(batch.num_rows, t, np.int32)), pa.array(found[:, t].astype(np.int64)), *batch.columns],
                    ["tbl", "sig", "id", "embedding"])

    schema = T.StructType([T.StructField("tbl", T.IntegerType()), T.StructField("sig", T.LongType()), *clean.schema.fields])
    clean.mapInArrow(sign, schema).hint("rebalance", "tbl", "sig").sortWithinPartitions("tbl", "sig").write.parquet(f"{path}/buckets")
    buckets = spark.read.schema(schema).parquet(f"{path}/buckets")
    buckets.groupBy("tbl", "sig").agg(F.count("*").alias("n")).write.parquet(f"{path}/sizes")
    spark.createDataFrame([(dim, tables, bits, k_max)], "dim int, tables int, bits int, k_max int").coalesce(1).write.parquet(
        f"{path}/shape")
    return open_signs(spark, path)


def open_signs(spark: SparkSession, path: str) -> SignIndex:
    """The index that ``build_signs`` wrote at ``path``, for any number of sessions."""
    shape = spark.read.parquet(f"{path}/shape").first()
    return SignIndex(spark.read.parquet(f"{path}/buckets"), spark.read.parquet(f"{path}/sizes"), **shape.asDict())


def _visits(queries: DataFrame, index: SignIndex, flips: int, vector: bool) -> DataFrame:
    """A row for each query and bucket it looks into: (tbl, sig, query_id), and the query's
    vector if wanted."""
    shared = queries.sparkSession.sparkContext.broadcast(planes(index.dim, index.tables, index.bits))
    masks = np.array([sum(1 << b for b in some) for n in range(flips + 1) for some in combinations(range(index.bits), n)])
    dim, tables, names = index.dim, index.tables, ["tbl", "sig", "query_id"] + ["embedding"] * vector

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        each = tables * len(masks)
        step = max(1, 100_000 // each)  # queries whose rows go out at once
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                vectors = batch.column("embedding").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)
                sigs = _signatures(vectors, shared.value)[:, :, None] ^ masks
                rows = pa.array(np.repeat(np.arange(batch.num_rows), each))
                tbl = np.tile(np.repeat(np.arange(tables, dtype=np.int32), len(masks)), batch.num_rows)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(tbl), pa.array(sigs.ravel().astype(np.int64)), *(batch.column(c).take(rows) for c in names[2:])], names)

    fields = [T.StructField("tbl", T.IntegerType()), T.StructField("sig", T.LongType()), *(queries.schema[c] for c in names[2:])]
    return queries.mapInArrow(look, T.StructType(fields))


def _candidates(queries: DataFrame, index: SignIndex, k: int, flips: int) -> DataFrame:
    """Best k of each query and bucket block, as (query_id, id, score), each pair once."""
    hit = S._hit_schema(queries.schema["query_id"].dataType, index.buckets.schema["id"].dataType)
    # a query's hits of a block go out as one row, so its id is shuffled once for all of them
    schema = T.StructType([hit["query_id"], T.StructField("hits", T.ArrayType(T.StructType(hit.fields[1:])))])
    flat, dim = S._hit_arrow(hit), index.dim
    arrow = pa.schema([flat.field(0), ("hits", pa.list_(pa.struct([flat.field(1), flat.field(2)])))])
    asked = _visits(queries, index, flips, False).groupBy("tbl", "sig").agg(F.count("*").alias("asked"))
    # a row for each bucket that is asked and not empty; it may be many, so Spark decides how to join
    points_in, queries_in = (max(1, most // (8 * dim)) for most in (POINT_BYTES, QUERY_BYTES))
    layout = written(index.sizes.join(asked, ["tbl", "sig"]).select(
        "tbl", "sig", F.ceil(F.col("n") / points_in).cast("int").alias("parts"),
        F.ceil(F.col("asked") / queries_in).cast("int").alias("lots")), "layout")

    def number(of: str, blocks: str):
        return F.pmod(F.xxhash64(of), F.col(blocks)).cast("int")

    def every(blocks: str):
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    lhs = _visits(queries, index, flips, True).join(layout, ["tbl", "sig"]).withColumn(
        "lot", number("query_id", "lots")).withColumn("part", every("parts"))
    rhs = index.buckets.join(layout, ["tbl", "sig"]).withColumn("part", number("id", "parts")).withColumn("lot", every("lots"))
    keys = ["tbl", "sig", "part", "lot"]

    def score(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return arrow.empty_table()
        best = S._Best(S._matrix(asking.column("embedding"), dim), k)
        best.add(S._values(held.column("id")), S._matrix(held.column("embedding"), dim))
        return _by_query(best.table(S._values(asking.column("query_id")), flat), best.rows, arrow)

    scored = lhs.select(*keys, "query_id", "embedding").groupBy(*keys).cogroup(
        rhs.select(*keys, "id", "embedding").groupBy(*keys)).applyInArrow(score, schema)
    return scored.repartition("query_id").select("query_id", F.inline("hits")).groupBy("query_id", "id").agg(
        F.max("score").alias("score"))


def _by_query(hits: pa.Table, rows: np.ndarray, schema: pa.Schema) -> pa.Table:
    """The hits (query_id, id, score) of each query as a list; ``rows``: the number of its query."""
    if not hits.num_rows:
        return schema.empty_table()
    order = np.argsort(rows, kind="stable")
    rows, hits = rows[order], hits.take(pa.array(order)).combine_chunks()
    first = np.flatnonzero(np.append(True, rows[1:] != rows[:-1]))
    entries = pa.StructArray.from_arrays([hits.column(c).chunk(0) for c in ("id", "score")], ["id", "score"])
    lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(rows)), pa.int32()), entries)
    return pa.table([hits.column("query_id").take(pa.array(first)), lists.cast(schema.field("hits").type)], schema=schema)


def sign_top_k(queries: DataFrame, index: SignIndex, k: int = 10, flips: int = FLIPS) -> DataFrame:
    """(query_id, rank, id, score): best k of those in buckets up to ``flips`` signs from each
    of ``queries`` (query_id, embedding). Of queries that repeat an id the one with the least
    vector is asked; those without a direction or of another dimension have no hits."""
    if k > index.k_max:
        raise ValueError(f"the index keeps {index.k_max} copies of a vector; k may not exceed it")

    def answer(distinct: DataFrame) -> DataFrame:
        fit = S._usable(distinct, "embedding", index.dim).filter(F.exists("embedding", lambda x: x != 0))
        most = index.sizes.filter("tbl = 0").agg(F.sum("n")).first()[0] or 0
        left, out = fit, None
        for n in range(min(flips, index.bits), index.bits + 1):
            hits = written(S.best_k(_candidates(left, index, k, n), k), "hits")
            short = left.join(hits.filter(F.col("rank") == min(k, most)).select("query_id"), "query_id", "left_anti")
            if not most or n == index.bits or short.isEmpty():
                return hits if out is None else out.unionByName(hits)
            left = written(short, "short")
            hits = hits.join(left.select("query_id"), "query_id", "left_anti")
            out = hits if out is None else out.unionByName(hits)

    return S._once_per_vector(S.one_per_id(queries), answer)
