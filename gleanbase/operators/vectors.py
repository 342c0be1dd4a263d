"""Vector columns: checks, normalising, writing to a collection."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..session import written
from ..sources.tables import VectorTable
from .blocks import replace_parts


def norm(vector: Column) -> Column:
    return F.sqrt(F.aggregate(vector, F.lit(0.0), lambda acc, x: acc + x.cast("double") * x.cast("double")))


def unit(vector: Column) -> Column:
    """The vector over its length, in doubles; a zero vector gives null."""
    wide = vector.cast("array<double>")
    # the length is worked out once per row, not once per element
    return F.element_at(
        F.transform(
            F.array(norm(wide)),
            lambda n: F.when(n > 0, F.transform(wide, lambda x: x / n)),
        ), 1)


def is_vector(vector: Column, dim: int) -> Column:
    whole = (F.size(vector) == dim) & ~F.exists(vector, lambda x: x.isNull() | F.isnan(x))
    return F.coalesce(whole, F.lit(False))


def split_valid(points: DataFrame, dim: int, column: str = "embedding") -> tuple[DataFrame, DataFrame]:
    """Points fit to store, made unit length, and rejects with a reason."""
    made = points.withColumn("_unit", F.when(is_vector(F.col(column), dim), unit(F.col(column))))
    good = made.filter(F.col("_unit").isNotNull()).withColumn(
        column, F.col("_unit").cast("array<float>")).drop("_unit")
    why = F.when(is_vector(F.col(column), dim), "zero vector").otherwise("wrong dimension")
    return good, made.filter(F.col("_unit").isNull()).withColumn("reason", why).drop("_unit")


def upsert_points(table: VectorTable, points: DataFrame) -> None:
    """Store points (one per id); a new point replaces the old one whole. They are checked and written once
    first: the upsert reads its batch more than once."""
    good, _ = split_valid(points, table.dim)
    table.upsert(written(good.select("id", "embedding", "payload"), "points"), replace_parts)
