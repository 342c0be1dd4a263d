"""Small helpers of the operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


def fresh(df: DataFrame, *stems: str) -> list[str]:
    """Column names that ``df`` does not have, in any case, one for each stem."""
    taken, names = {c.lower() for c in df.columns}, []
    for stem in stems:
        name = stem
        while name.lower() in taken:
            name = f"_{name}"
        taken.add(name.lower())
        names.append(name)
    return names


def appended(schema: T.StructType, **kinds: T.DataType) -> T.StructType:
    return T.StructType([*schema.fields, *(T.StructField(n, k) for n, k in kinds.items())])


def others(docs: DataFrame, place: int, *made: str) -> list[int]:
    """Places of the columns that stay beside new ones: not ``place``, and none named like ``made``, in any case."""
    names = {n.lower() for n in made}
    return [k for k, c in enumerate(docs.columns) if k != place and c.lower() not in names]


def without(docs: DataFrame, ids: DataFrame, key: str = "doc_id") -> DataFrame:
    """``docs`` less the rows whose key is in the column ``key`` of ``ids``; rows with a
    null key stay. The ids may be as many as the rows, so they are never broadcast."""
    name, = fresh(docs, "_gone")
    gone = ids.select(F.col(key).alias(name)).filter(F.col(name).isNotNull()).distinct()
    return docs.join(gone.hint("merge"), docs[key] == gone[name], "left_anti")


def joined(items: Column) -> Column:
    return F.concat_ws(",", items)
