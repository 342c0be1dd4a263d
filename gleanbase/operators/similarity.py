"""Cosine top-k of query vectors over a table of points.

Order within an answer: score rounded to four decimals (halves away from zero),
descending, then id. A point or query counts if its vector has the dimension that most
points have; of queries that repeat an id the one with the least vector is asked. Three ways
to the same result form (query_id, rank, id, score):

* scan: few queries (checked) go to every task as a matrix; one pass over the points,
  each task keeps its best k per query.
* tree: any number of queries, by a tree of pivots with bounded leaves (``tree.py``).
* approximate: points lie in cells around sampled pivots, and the ``probes`` nearest cells of
  each query are scored. (``signs.py`` has another approximate way, by signatures.)

Scoring runs on blocks of bounded size on both sides, so a crowded cell becomes many
tasks. Equal vectors are handled once: of the points no more than k copies of a vector
can be in an answer (the lowest ids), and equal queries share their answer.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import scratch_path, written
from .rows import ranked
from .skew import salted_join
from .spread import in_parts

DIGITS = 4
SCAN_QUERIES = 4096          # most queries sent to every task
SCAN_BYTES = 64 << 20        # and their most bytes
SCAN_HITS = 500_000          # and hits asked for
MAX_PIVOTS = 16_384           # pivots are held by every task,
PIVOT_BYTES = 64 << 20       # in no more than this
POINT_BLOCK = 16_384         # rows of a scoring block
QUERY_BLOCK = 4096
_CELLS_AT_ONCE = 2_000_000   # entries of a score matrix in a worker
_GROUPS = 512                # groups of points whose maxima bound the k-th score
_ANGLE_SLACK = 1e-6          # arccos near 1 is good to about 1e-8
_SCORE_SLACK = 0.5 * 10.0 ** -DIGITS + 1e-9


# --- small numpy helpers used inside the tasks ---------------------------------------

def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    rows = flat.reshape(-1, dim)
    with np.errstate(divide="ignore", invalid="ignore"):
        return rows / np.sqrt((rows * rows).sum(axis=1, keepdims=True))


def _score_key(scores: np.ndarray) -> np.ndarray:
    """Scores in units of the last digit shown; the same steps as ``score_key``."""
    return np.sign(scores) * np.floor(np.abs(scores) * 10.0 ** DIGITS + 0.5)


def _first_k(rows: np.ndarray, keys: np.ndarray, tie: np.ndarray, k: int) -> np.ndarray:
    """Positions of the k best of each row: key descending, tie ascending."""
    order = np.lexsort((tie, -keys, rows))
    sorted_rows = rows[order]
    place = np.arange(len(order)) - np.searchsorted(sorted_rows, sorted_rows, "left")
    return order[place < k]


class _Best:
    """The best k points seen so far for each of n queries."""

    def __init__(self, queries: np.ndarray, k: int):
        self.queries, self.k = queries, k
        self.rows = np.empty(0, np.int64)
        self.scores = np.empty(0)
        self.ids = None

    def add(self, ids: np.ndarray, points: np.ndarray) -> None:
        whole = np.isfinite(points).all(axis=1)
        ids, points = ids[whole], points[whole]
        for at in range(0, len(ids), POINT_BLOCK):
            self._add(ids[at:at + POINT_BLOCK], points[at:at + POINT_BLOCK])

    def _add(self, ids: np.ndarray, points: np.ndarray) -> None:
        order = np.unique(ids, return_inverse=True)[1]
        rows, cols, scores = [], [], []
        step = max(1, _CELLS_AT_ONCE // len(ids))
        for at in range(0, len(self.queries), step):
            for r, c in self._may(self.queries[at:at + step], points):
                s = np.einsum("ij,ij->i", self.queries[r + at], points[c])
                keep = _first_k(r, _score_key(s), order[c], self.k)
                rows.append(r[keep] + at)
                cols.append(c[keep])
                scores.append(s[keep])
        if not rows:
            return
        rows, cols, scores = (np.concatenate(part) for part in (rows, cols, scores))
        all_rows = np.concatenate([self.rows, rows])
        all_scores = np.concatenate([self.scores, scores])
        all_ids = ids[cols] if self.ids is None else np.concatenate([self.ids, ids[cols]])
        tie = order[cols] if self.ids is None else np.unique(all_ids, return_inverse=True)[1]
        keep = _first_k(all_rows, _score_key(all_scores), tie, self.k)
        self.rows, self.scores, self.ids = all_rows[keep], all_scores[keep], all_ids[keep]

    def _may(self, queries: np.ndarray, points: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Rows and columns of the pairs that may be among the best k, some at a time. Products
        in single precision rule out the others: the k-th greatest of the maxima of groups of
        points is no more than the k-th score, but for the error of such a product."""
        n, dim = points.shape
        if n <= self.k:
            rows, cols = (a.ravel() for a in np.indices((len(queries), n)))
        else:
            rough = queries.astype(np.float32) @ points.astype(np.float32).T
            groups = max(_GROUPS, 4 * self.k)
            tops = rough
            if n >= 2 * groups:
                deep = n // groups
                tops = rough[:, :deep * groups].reshape(len(queries), deep, groups).max(axis=1)
            least = np.partition(tops, -self.k, axis=1)[:, -self.k]
            error = 4 * dim * float(np.finfo(np.float32).eps) + 2 * _SCORE_SLACK
            rows, cols = np.nonzero(rough >= (least - np.float32(error))[:, None])
        out = max(1, 2 * _CELLS_AT_ONCE // dim)
        for at in range(0, len(rows), out):
            yield rows[at:at + out], cols[at:at + out]

    def table(self, query_ids: np.ndarray, schema: pa.Schema) -> pa.Table:
        if self.ids is None:
            return schema.empty_table()
        return pa.table([pa.array(query_ids[self.rows], schema.field(0).type),
                         pa.array(self.ids, schema.field(1).type),
                         pa.array(self.scores)], schema=schema)


def _values(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


# --- shared DataFrame pieces ----------------------------------------------------------

def score_key(score: Column) -> Column:
    """What orders hits, in tasks (``_score_key``) and here: the score in units of its last
    digit shown, halves away from zero. Both do the same operations on the same doubles."""
    return F.signum(score) * F.floor(F.abs(score) * F.lit(10.0 ** DIGITS) + F.lit(0.5)).cast("double")


def shown_score(score: Column) -> Column:
    return score_key(score) / F.lit(10.0 ** DIGITS) + F.lit(0.0)


def best_k(pairs: DataFrame, k: int) -> DataFrame:
    out = ranked(pairs, ["query_id"], [score_key(F.col("score")).desc(), F.col("id")], k)
    return out.select("query_id", "rank", "id", "score")


def _hit_schema(query_type: T.DataType, id_type: T.DataType) -> T.StructType:
    return T.StructType([T.StructField("query_id", query_type), T.StructField("id", id_type),
                         T.StructField("score", T.DoubleType())])


def _arrow(kind: T.DataType) -> pa.DataType:
    return {"string": pa.string(), "bigint": pa.int64(), "int": pa.int32()}[kind.simpleString()]


def _hit_arrow(schema: T.StructType) -> pa.Schema:
    return pa.schema([("query_id", _arrow(schema[0].dataType)), ("id", _arrow(schema[1].dataType)),
                      ("score", pa.float64())])


def _fingerprint(vector: Column) -> Column:
    """128 bits that stand for a vector in groupings."""
    return F.concat(F.hex(F.xxhash64(vector)), F.lit("-"), F.hex(F.xxhash64(F.lit(7), vector)))


def _usable(df: DataFrame, vector: str, dim: int) -> DataFrame:
    return df.filter((F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull()))


def one_per_id(queries: DataFrame) -> DataFrame:
    """(query_id, embedding) with each id once; the least vector of those that share it."""
    return queries.groupBy("query_id").agg(F.min("embedding").alias("embedding"))


def common_dimension(points: DataFrame) -> tuple[int, int]:
    """The dimension that most points have (the least of several) and their number; all
    other points are unfit. (1, 0) without points."""
    common = points.groupBy(F.size("embedding").alias("dim")).count().filter("dim > 0").orderBy(
        F.col("count").desc(), "dim").first()
    return (common["dim"], common["count"]) if common else (1, 0)


def small_queries(queries: DataFrame, k: int) -> pa.Table | None:
    """The queries (query_id, embedding), each id once, if they and their hits are few, else
    None. Ids are taken first, which reads no more partitions than it needs to find too many."""
    most = min(SCAN_QUERIES, SCAN_HITS // max(1, k))
    if len(queries.select("query_id").take(most + 1)) > most:
        return None
    few = one_per_id(queries).toArrow()
    return few if few.nbytes <= SCAN_BYTES else None


# --- scan -----------------------------------------------------------------------------

def scan_top_k(few: pa.Table, query_type: T.DataType, points: DataFrame, k: int) -> DataFrame:
    """``few`` has each query_id once."""
    spark = points.sparkSession
    schema = _hit_schema(query_type, points.schema["id"].dataType)
    vectors = few.column("embedding").combine_chunks()
    sizes = [n or 0 for n in vectors.value_lengths().to_pylist()]
    dim, _ = common_dimension(points)
    few = few.filter(pa.array([n == dim and n > 0 for n in sizes]))
    if not few.num_rows:
        return spark.createDataFrame([], schema).withColumn("rank", F.lit(1)).select("query_id", "rank", "id", "score")
    matrix = _matrix(few.column("embedding"), dim)
    names = _values(few.column("query_id"))
    whole = np.isfinite(matrix).all(axis=1)
    shared = spark.sparkContext.broadcast((names[whole], matrix[whole]))
    arrow = _hit_arrow(schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, vectors = shared.value
        best = _Best(vectors, k)
        for batch in in_parts(batches, QUERY_BLOCK):
            best.add(_values(batch.column("id")), _matrix(batch.column("embedding"), dim))
        yield from best.table(query_ids, arrow).to_batches()

    # at most SCAN_HITS rows: written, so that what follows does not scan again
    return written(best_k(_usable(points.select("id", "embedding"), "embedding", dim).mapInArrow(run, schema), k), "hits")


# --- cells ----------------------------------------------------------------------------

@dataclass
class CellIndex:
    """Points by nearest pivot. ``stats``: cell -> (rows, least angle, greatest angle);
    pivots and stats are bounded by MAX_PIVOTS."""

    cells: DataFrame
    pivots: np.ndarray
    stats: dict[int, tuple[int, float, float]]
    k_max: int


def _pivot_count(rows: int) -> int:
    return int(min(MAX_PIVOTS, max(1, round(rows ** 0.5))))


def _first_by_lot(points: DataFrame, rows: int, n: int) -> pa.Table:
    """Vectors of the first n points in md5 order of their id. ``rows`` is no less than their
    number. Only lots under a threshold are ordered, so about 2n vectors reach the last task
    however many tasks there are; if they are too few, the threshold rises."""
    lot = F.md5(F.col("id").cast("string"))
    number = F.conv(F.substring(lot, 1, 8), 16, 10).cast("long")
    share = (2 * n + 64) / max(1, rows)
    while True:
        some = points.filter(number < F.lit(int(share * 2 ** 32))) if share < 1 else points
        heads = some.orderBy(lot, "id").limit(n).select("embedding").toArrow()
        if heads.num_rows == n or share >= 1:
            return heads
        share *= 8


def build_index(points: DataFrame, k_max: int = 10, pivots: int | None = None, path: str | None = None) -> CellIndex:
    """Write the cell index of (id, embedding).

    Pivots are points in md5 order of their id, so crowded regions get more of them and
    no cell is expected to hold more than its share; equal vectors, which no pivot could
    part, are cut to the k_max lowest ids first.
    """
    spark = points.sparkSession
    path = path or scratch_path(spark, "index")
    dim, rows = common_dimension(points)
    whole = _usable(points.select("id", "embedding"), "embedding", dim).filter(F.exists("embedding", lambda x: x != 0))
    most = min(MAX_PIVOTS, PIVOT_BYTES // (8 * dim))
    heads = _first_by_lot(whole, rows, min(pivots or _pivot_count(rows), most))
    centres = _matrix(heads.column("embedding"), dim) if heads.num_rows else np.zeros((0, dim))
    # copies among the pivots would make empty cells
    centres = centres[np.sort(np.unique(centres, axis=0, return_index=True)[1])]
    clean = ranked(whole.withColumn("_fp", _fingerprint(F.col("embedding"))), ["_fp"], [F.col("id")], k_max, "_n").drop(
        "_fp", "_n")
    shared = spark.sparkContext.broadcast(centres)

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cosine = _matrix(batch.column("embedding"), dim) @ shared.value.T
            cell = cosine.argmax(axis=1)
            angle = np.arccos(np.clip(cosine[np.arange(len(cell)), cell], -1, 1))
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(cell.astype(np.int32)), pa.array(angle)],
                ["id", "embedding", "cell", "angle"])

    schema = T.StructType([*clean.schema.fields, T.StructField("cell", T.IntegerType()),
                           T.StructField("angle", T.DoubleType())])
    if not heads.num_rows:
        placed = clean.withColumn("cell", F.lit(0)).withColumn("angle", F.lit(0.0)).filter(F.lit(False))
    else:
        placed = clean.mapInArrow(assign, schema)
    # AQE splits a crowded cell and joins small ones; sorted, so that a filter on cells skips
    # row groups
    placed.hint("rebalance", "cell").sortWithinPartitions("cell").write.parquet(f"{path}/cells")
    cells = spark.read.schema(schema).parquet(f"{path}/cells")
    cells.groupBy("cell").agg(F.count("*").alias("rows"), F.min("angle").alias("low"), F.max("angle").alias("high")) \
        .coalesce(1).write.parquet(f"{path}/stats")
    spark.createDataFrame([(n, c.tolist()) for n, c in enumerate(centres)], "cell int, pivot array<double>") \
        .withColumns({"dim": F.lit(dim), "k_max": F.lit(k_max)}).coalesce(1).write.parquet(f"{path}/pivots")
    return open_index(spark, path)


def open_index(spark: SparkSession, path: str) -> CellIndex:
    """The index that ``build_index`` wrote at ``path``, for any number of sessions. Pivots
    and bounds are read whole; there are no more than MAX_PIVOTS of them."""
    cells = spark.read.parquet(f"{path}/cells")
    pivots = spark.read.parquet(f"{path}/pivots").orderBy("cell").collect()
    centres = np.array([r["pivot"] for r in pivots]) if pivots else np.zeros((0, 1))
    stats = {r["cell"]: (r["rows"], r["low"], r["high"]) for r in spark.read.parquet(f"{path}/stats").collect()}
    return CellIndex(cells, centres, stats, pivots[0]["k_max"] if pivots else 1 << 30)


def _visits(queries: DataFrame, index: CellIndex, choose) -> DataFrame:
    """One row per (query, cell to score). ``choose`` gets the angles of some queries to all
    pivots and these queries, and gives row and cell numbers. Both the angles and the rows that
    go out at once are of bounded size."""
    shared = queries.sparkSession.sparkContext.broadcast(index.pivots)
    dim = index.pivots.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        step = max(1, _CELLS_AT_ONCE // max(1, len(shared.value)))
        out = max(1, _CELLS_AT_ONCE // dim)
        for whole in batches:
            for batch in (whole.slice(at, step) for at in range(0, whole.num_rows, step)):
                vectors = _matrix(batch.column("embedding"), dim)
                fit = np.isfinite(vectors).all(axis=1)
                cosine = np.where(fit[:, None], vectors, 0.0) @ shared.value.T
                rows, cells = choose(np.arccos(np.clip(cosine, -1, 1)), batch)
                use = fit[rows]
                rows, cells = rows[use], cells[use].astype(np.int32)
                asked = batch.select(["query_id", "embedding"])
                for at in range(0, len(rows), out):
                    part = asked.take(pa.array(rows[at:at + out]))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(cells[at:at + out])],
                                                     ["query_id", "embedding", "cell"])

    schema = T.StructType([queries.schema["query_id"], queries.schema["embedding"],
                           T.StructField("cell", T.IntegerType())])
    return _usable(queries, "embedding", dim).mapInArrow(run, schema)


def _score(visits: DataFrame, index: CellIndex, k: int) -> DataFrame:
    """Best k per query and block for all visits, as (query_id, id, score)."""
    spark = visits.sparkSession
    dim = index.pivots.shape[1]
    schema = _hit_schema(visits.schema["query_id"].dataType, index.cells.schema["id"].dataType)
    arrow = _hit_arrow(schema)
    # one row per cell at most
    asked = {r[0]: r[1] for r in visits.groupBy("cell").agg(F.count("*")).collect()}
    plan = [(c, -(-index.stats[c][0] // POINT_BLOCK), -(-n // QUERY_BLOCK))
            for c, n in asked.items() if c in index.stats]
    if not plan:
        return spark.createDataFrame([], schema)
    layout = F.broadcast(spark.createDataFrame(plan, "cell int, parts int, lots int"))

    def number(of: str, blocks: str) -> Column:
        return F.pmod(F.xxhash64(of), F.col(blocks)).cast("int")

    def every(blocks: str) -> Column:
        return F.explode(F.sequence(F.lit(0), F.col(blocks) - 1))

    lhs = visits.join(layout, "cell").withColumn("lot", number("query_id", "lots")).withColumn("part", every("parts"))
    rhs = (
        index.cells.filter(F.col("cell").isin([c for c, _, _ in plan])).join(layout, "cell")
        .withColumn("part", number("id", "parts")).withColumn("lot", every("lots"))
    )
    keys = ["cell", "part", "lot"]

    def score(asking: pa.Table, held: pa.Table) -> pa.Table:
        if not asking.num_rows or not held.num_rows:
            return arrow.empty_table()
        best = _Best(_matrix(asking.column("embedding"), dim), k)
        best.add(_values(held.column("id")), _matrix(held.column("embedding"), dim))
        return best.table(_values(asking.column("query_id")), arrow)

    return (
        lhs.select(*keys, "query_id", "embedding").groupBy(*keys)
        .cogroup(rhs.select(*keys, "id", "embedding").groupBy(*keys))
        .applyInArrow(score, schema)
    )


def _nearest(probes: int):
    def choose(angles: np.ndarray, batch) -> tuple[np.ndarray, np.ndarray]:
        near = np.argsort(angles, axis=1, kind="stable")[:, :probes]
        return np.repeat(np.arange(len(near)), near.shape[1]), near.ravel()
    return choose


def _once_per_vector(queries: DataFrame, answer) -> DataFrame:
    """Answer each distinct query vector once and hand the answer to all its queries."""
    marked = queries.select("query_id", "embedding").withColumn("_fp", _fingerprint(F.col("embedding")))
    distinct = written(
        marked.select(F.col("_fp").alias("query_id"), "embedding").dropDuplicates(["query_id"]), "queries")
    askers = written(marked.select("_fp", "query_id"), "askers")
    found = answer(distinct).withColumnRenamed("query_id", "_fp")
    return written(salted_join(askers, found, "_fp", "inner", F.col("query_id")).select(
        "query_id", "rank", "id", "score"), "hits")


def approx_top_k(queries: DataFrame, index: CellIndex, k: int = 10, probes: int = 8) -> DataFrame:
    """Best k among the ``probes`` nearest cells of each query."""
    _check(index, k)
    return _once_per_vector(queries, lambda q: best_k(_score(_visits(q, index, _nearest(probes)), index, k), k))


def _check(index: CellIndex, k: int) -> None:
    if k > index.k_max:
        raise ValueError(f"the index keeps {index.k_max} copies of a vector; k may not exceed it")


# --- entry points ---------------------------------------------------------------------

def top_k(queries: DataFrame, points: DataFrame, k: int = 10) -> DataFrame:
    """Exact best k of ``points`` (id, embedding) for each of ``queries`` (query_id,
    embedding): by scan when the queries are few, by a tree of pivots otherwise."""
    from .tree import build_tree, tree_top_k  # it builds on this module
    few = small_queries(queries, k)
    if few is not None:
        return scan_top_k(few, queries.schema["query_id"].dataType, points, k)
    return tree_top_k(queries, build_tree(points, k_max=k), k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true hits that were found, in one row."""
    marked = truth.select("query_id", "id").join(
        found.select("query_id", "id", F.lit(1).alias("_f")), ["query_id", "id"], "left")
    return marked.agg(F.round(F.count("_f") / F.count("*"), DIGITS).alias("recall"))
