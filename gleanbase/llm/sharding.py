"""Sharding by a permutation-filled lookup table.

Each shard has its own order of preference over the slots of a table of prime size; shards
take turns, and each claims the first slot in its order that is free. Shards get equally
many slots, give or take one, and when a shard is added or leaves, few slots change hands.
"""

from __future__ import annotations

from hashlib import md5

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fresh

SLOTS = 65_537  # prime; at least a hundred times the shards evens them out


def _number(name: str, salt: str) -> int:
    return int(md5(f"{salt}:{name}".encode()).hexdigest()[:15], 16)


def lookup_table(shards: list[str], slots: int = SLOTS) -> np.ndarray:
    """Number (in ``shards``) of the shard of each slot."""
    if not shards or len(set(shards)) != len(shards) or len(shards) > slots:
        raise ValueError("name each shard once, and no more shards than slots")
    if any(slots % k == 0 for k in range(2, int(slots ** 0.5) + 1)):
        raise ValueError(f"{slots} is not prime")
    first = [_number(s, "first") % slots for s in shards]
    step = [_number(s, "step") % (slots - 1) + 1 for s in shards]
    table, turn, left = [-1] * slots, [0] * len(shards), slots
    while True:
        for n in range(len(shards)):
            place = (first[n] + turn[n] * step[n]) % slots
            while table[place] >= 0:
                turn[n] += 1
                place = (first[n] + turn[n] * step[n]) % slots
            table[place] = n
            turn[n] += 1
            left -= 1
            if not left:
                return np.array(table)


def place(docs: DataFrame, shards: list[str], key: str = "doc_id", slots: int = SLOTS,
          into: tuple[str, str] = ("slot", "shard")) -> DataFrame:
    """``docs`` with the slot of each key and the shard that holds it.

    The slot is a hash of the key as text, modulo the size of the table; the table has
    ``slots`` rows and is broadcast, so rows stay where they are. A null key takes the slot
    of the empty text. Equal keys go to one shard. Columns named as ``into`` are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in into and c != key])
    table = [(n, shards[k]) for n, k in enumerate(lookup_table(shards, slots).tolist())]
    slot, shard = fresh(docs, "_slot", "_shard")
    lookup = docs.sparkSession.createDataFrame(table, f"`{slot}` long, `{shard}` string")
    hashed = F.conv(F.substring(F.md5(F.coalesce(F.col(key).cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10)
    numbered = docs.withColumn(into[0], F.pmod(hashed.cast("long"), F.lit(slots)))
    return numbered.join(F.broadcast(lookup), numbered[into[0]] == lookup[slot]).select(
        *docs.columns, into[0], F.col(shard).alias(into[1]))


def write_shards(placed: DataFrame, path: str, rows_per_file: int = 100_000, parts: int = 8) -> None:
    """One folder per shard. A shard is written by ``parts`` tasks, by slot, and no file holds
    more than ``rows_per_file`` rows."""
    salt, = fresh(placed, "_part")
    (placed.withColumn(salt, F.pmod(F.col("slot"), F.lit(parts))).repartition("shard", salt).drop(salt)
     .write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path))
