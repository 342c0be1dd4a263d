"""SimHash near-duplicates through deletion-variant signatures.

Fingerprints of 64 bits link at two or fewer differing bits. Cut into two halves, one half
of a linked pair differs by at most one bit; each half is indexed once for every bit taken
as a wildcard (64 keys per fingerprint), and fingerprints that share a key are compared in
full. A key that many fingerprints share is not expanded into pairs: its members are indexed
by all values within one bit of them instead. Those at two or fewer bits from each other
share such a value, at most 65 fingerprints can share one, and all that do are linked, so
the work stays linear and no link is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import appended, others
from .components import components

WORDS = 3  # words of a shingle
SEED = 42
CROWD = 16  # members of a key up to which pairs are compared
_PART = 1 << 15  # shingles handled at once


def fingerprint(text: str | None, words: int = WORDS, seed: int = SEED) -> int:
    """Bits set in over half of the shingles' hashes, as a signed 64-bit number."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII separators only
    if not tokens:
        return 0
    n, digest = max(1, len(tokens) - words + 1), xxhash.xxh64_intdigest
    ones = np.zeros(64, np.int64)
    for start in range(0, n, _PART):
        hashes = np.array([digest(b" ".join(tokens[k:k + words]), seed) for k in range(start, min(n, start + _PART))],
                          "<u8")
        ones += np.unpackbits(hashes.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = np.packbits(2 * ones > n, bitorder="little")
    return int(bits.view("<i8")[0])


def fingerprints(docs: DataFrame, text: str = "text", into: str = "fp") -> DataFrame:
    """``docs`` with its column ``text`` replaced by the fingerprint of the whole text; null
    and empty texts have fingerprint zero. A column named as ``into`` is replaced."""
    place = docs.columns.index(text)
    rest = others(docs, place, into)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = pa.array([fingerprint(value.as_py()) for value in batch.column(place)], pa.int64())
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), made],
                                             [*(batch.schema.names[k] for k in rest), into])

    kept = T.StructType([docs.schema.fields[k] for k in rest])
    return docs.mapInArrow(run, appended(kept, **{into: T.LongType()}))


def _near(a: str, b: str) -> Column:
    return F.bit_count(F.col(a).bitwiseXOR(F.col(b))) <= 2


def _variants(prints: DataFrame) -> DataFrame:
    """(fp, key): half, wildcard bit and the other 31 bits of that half, packed in a long."""
    each = prints.select("fp", F.explode(F.sequence(F.lit(0), F.lit(63))).alias("j"))
    half = "(CASE WHEN j % 2 = 0 THEN fp & 4294967295L ELSE shiftrightunsigned(fp, 32) END)"
    return each.select("fp", F.expr(f"shiftleft({half} & ~shiftleft(1L, CAST(j DIV 2 AS INT)), 6) | j").alias("key"))


def _crowded(members: DataFrame) -> DataFrame:
    """Links among fingerprints by the values within one bit of them."""
    nearby = members.select("fp", F.explode(F.expr(
        "concat(array(fp), transform(sequence(0, 63), b -> fp ^ shiftleft(1L, b)))")).alias("x"))
    groups = nearby.groupBy("x").agg(F.collect_set("fp").alias("all"))  # at most 65
    return groups.filter(F.size("all") > 1).select(
        F.array_min("all").alias("a"), F.explode("all").alias("b")).filter("a < b")


def links(prints: DataFrame, crowd: int = CROWD) -> DataFrame:
    """Pairs (a, b) of distinct fingerprints that, with chains of them, connect all that
    link at two or fewer bits. ``prints`` is a written table of distinct ``fp``."""
    # each print becomes 64 rows, so they are dealt over all partitions, however few bytes they are
    prints = prints.repartition(int(prints.sparkSession.conf.get("spark.sql.shuffle.partitions")), "fp")
    keys = written(_variants(prints).groupBy("key").agg(
        F.count("*").alias("n"), F.min("fp").alias("a"), F.max("fp").alias("b")).filter("n > 1"), "keys")
    two = keys.filter("n = 2").select("a", "b")
    # shared keys grow with the corpus, so they are never broadcast
    shared = written(_variants(prints).join(keys.filter("n > 2").select("key", "n").hint("merge"), "key"), "shared")
    some = shared.filter(F.col("n") <= crowd).groupBy("key").agg(F.collect_list("fp").alias("all"))
    pairs = some.select(F.explode("all").alias("a"), "all").select("a", F.explode("all").alias("b")).filter("a < b")
    near = two.unionByName(pairs).filter(_near("a", "b"))
    many = shared.filter(F.col("n") > crowd).select("fp").distinct()
    return near.unionByName(_crowded(many)).distinct()


def near_duplicates(docs: DataFrame, text: str = "text", key: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """(key, fingerprint, component_id) of every row.

    ``component_id`` is the least key of the documents reachable over links. Rows with equal
    fingerprints are one node, however many they are. Null and empty texts have fingerprint
    zero and link to each other like any others. A row with a null key takes part; a
    component of such rows alone has a null id. Repeated rows get equal answers.
    """
    rows = written(fingerprints(docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))), "prints")
    nodes = written(rows.groupBy("fp").agg(F.min("doc").alias("least")), "nodes")
    found = written(components(links(nodes.select("fp"), crowd)), "roots")
    linked = found.join(nodes, found["node"] == nodes["fp"]).select("fp", "root", "least")
    least = linked.groupBy("root").agg(F.min("least").alias("component"))
    linked = linked.join(least, "root").select("fp", "component")
    classes = nodes.join(linked, "fp", "left").select("fp", F.coalesce("component", "least").alias("component"))
    return rows.join(classes, "fp").select(
        F.col("doc").alias(key), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"),
        F.col("component").alias("component_id"))
