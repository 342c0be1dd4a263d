"""Near copies by the shingles they share: MinHash bands find candidates, sets decide.

Texts are near copies if the Jaccard similarity of their sets of five-word shingles is 0.8
or more. Texts that agree in a band (the least values of ``ROWS`` hashes) are candidates,
and each candidate pair is compared by its whole sets. A pair at similarity s agrees in no
band with probability (1 - s^4)^24: three in a million at 0.8, less above.

A band that many texts share is never expanded into pairs. Its members are compared with one
of them, the star: the member whose bands are shared by most others, which for a family of
copies is the text they come from. Rounds of stars go on while they pay. Of each component
found so far the least text then stands for it, and these few are joined exactly by their
rarest shingles: texts at 0.8 or more must share one of the first fifth of the shingles of
the longer and the first ninth of those of the shorter, in order of how many texts have them.
In a family of texts that are alike but no copies that fifth is what each has of its own, so
it makes no candidates. No two near copies that share a band are left.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .components import components

WORDS = 5  # words of a shingle
SIMILAR = 0.8
BANDS, ROWS = 24, 4
SEED = 42
CROWD = 16  # members of a band up to which all pairs are compared
PAYS = 0.1  # share of the members of large bands that a round of stars must link for another
_PART = 1 << 12  # shingles handled at once


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; a text of fewer words is one shingle."""
    tokens = (text or "").encode("utf-8", "surrogatepass").lower().split()  # bytes: A-Z and ASCII separators only
    n, digest = max(1, len(tokens) - words + 1) if tokens else 0, xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(b" ".join(tokens[k:k + words]), SEED) for k in range(n)), np.uint64, n))


def bands(hashes: np.ndarray) -> list[int]:
    """One signed 64-bit key for each band, none for a text without words."""
    if not len(hashes):
        return []
    rng = np.random.default_rng(SEED)
    mask, odd = (rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) for _ in range(2))
    odd |= np.uint64(1)
    least = np.full(BANDS * ROWS, np.iinfo(np.uint64).max)
    for start in range(0, len(hashes), _PART):
        mixed = (hashes[start:start + _PART] ^ mask) * odd
        mixed = (mixed ^ mixed >> np.uint64(32)) * np.uint64(0x9E3779B97F4A7C15)
        least = np.minimum(least, mixed.min(axis=1))
    packed = least.astype("<u8").reshape(BANDS, ROWS)
    keys = [xxhash.xxh64_intdigest(row.tobytes(), band) for band, row in enumerate(packed)]
    return np.array(keys, np.uint64).view(np.int64).tolist()


def similarity(a: np.ndarray, b: np.ndarray) -> float:
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both / max(1, len(a) + len(b) - both)


def paired(members: DataFrame) -> DataFrame:
    """(a, b, n, m): all pairs of the members (doc, n) of each band, which has few."""
    some = members.groupBy("band").agg(F.collect_list(F.struct("doc", "n")).alias("all"))
    each = some.select(F.explode("all").alias("x"), "all").select("x", F.explode("all").alias("y"))
    return each.filter("x.doc < y.doc").selectExpr("x.doc AS a", "y.doc AS b", "x.n AS n", "y.n AS m")


def starred(members: DataFrame) -> DataFrame:
    """(a, b, n, m): each member (doc, n, band, members) with the star of its band, the doc
    whose bands have most members in all, the least of several."""
    weight = members.groupBy("doc").agg(F.sum("members").alias("weight"))
    known = members.join(weight.hint("merge"), "doc")
    stars = known.groupBy("band").agg(F.min_by(F.struct("doc", "n"), F.struct(-F.col("weight"), "doc")).alias("star"))
    return members.join(stars.hint("merge"), "band").filter("doc != star.doc").selectExpr(
        "star.doc AS a", "doc AS b", "star.n AS n", "n AS m").distinct()


def by_rarest(tokens: DataFrame) -> DataFrame:
    """(a, b, n, m): candidates among the sets in ``tokens`` (doc, n, token), n the size of
    the set. Every pair at ``SIMILAR`` or more is among them.

    The tokens of a set are put in order of the number of sets that have them. Such a pair
    shares at least 2s/(1+s) of the tokens of the smaller set and s of those of the larger,
    so its first shared token is among the first tokens of both, and what follows it in both
    is long enough for the rest.
    """
    counts = tokens.groupBy("token").agg(F.count("*").alias("sets")).filter("sets > 1")
    known = tokens.join(counts.hint("merge"), "token")
    ordered = known.groupBy("doc", "n").agg(F.sort_array(F.collect_list(F.struct("sets", "token"))).alias("all"))
    # tokens that no other set has come first; they need no rows
    own, small, large = "(n - size(all))", f"ceil({2 * SIMILAR / (1 + SIMILAR)!r}D * n - 1e-9D)", f"ceil({SIMILAR!r}D * n - 1e-9D)"
    first = ordered.filter(f"n - {large} + 1 > {own}").select("doc", "n", F.posexplode(F.expr(
        f"slice(all, 1, CAST(n - {large} + 1 - {own} AS INT))")).alias("k", "token"), F.expr(own).alias("own"),
        F.expr(f"n - {small} + 1").alias("small"))
    first = written(first.selectExpr("token.token AS token", "doc", "n", "k + own AS k", "k + own < small AS small"), "rarest")
    x = first.filter("small").selectExpr("token", "doc AS a", "n", "k")
    y = first.selectExpr("token", "doc AS b", "n AS m", "k AS l")
    share = SIMILAR / (1 + SIMILAR)
    return x.join(y.hint("merge"), "token").filter(
        f"(n < m OR n = m AND a < b) AND n >= {SIMILAR!r}D * m - 1e-9D"
        f" AND least(n - k, m - l) >= {share!r}D * (n + m) - 1e-9D").select("a", "b", "n", "m").distinct()


def near_copies(docs: DataFrame, text: str = "text", key: str = "doc_id", crowd: int = CROWD) -> DataFrame:
    """(key) of the texts that go so that no two near copies are left.

    The least key of each component of the links found stays. Rows that repeat a key are
    one text, near another if any of them is. Rows with a null key and texts without words
    take no part.
    """
    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter(F.col("doc").isNotNull())
    doc = T.StructField("doc", rows.schema["doc"].dataType)

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(value.as_py()) for value in batch.column(1)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(s) for s in sets], pa.int64()),
                 pa.array([bands(s) for s in sets], pa.list_(pa.int64()))], ["doc", "n", "bands"])

    def collect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = pa.array([shingles(value.as_py()).tobytes() for value in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), sets], ["doc", "set"])

    def spell(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in range(batch.num_rows):  # one text at a time
                tokens = np.frombuffer(batch.column(2)[row].as_py(), np.int64)
                same = pa.array(np.full(len(tokens), row))
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).take(same), batch.column(1).take(same), pa.array(tokens)], ["doc", "n", "token"])

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            near = [similarity(*(np.frombuffer(s.as_py(), np.uint64) for s in pair)) >= SIMILAR
                    for pair in zip(batch.column(2), batch.column(3))]
            some = batch.select([0, 1]).filter(pa.array(near, pa.bool_()))
            yield pa.RecordBatch.from_arrays(some.columns, ["a", "b"])

    signed = written(rows.mapInArrow(sign, T.StructType([
        doc, T.StructField("n", T.LongType()), T.StructField("bands", T.ArrayType(T.LongType()))])), "signed")
    keyed = signed.select("doc", "n", F.explode("bands").alias("band"))
    pair = T.StructType([T.StructField(n, doc.dataType) for n in "ab"])

    def shared_bands(of: DataFrame) -> DataFrame:
        """Members (doc, n) of the bands that several share, with the number of them."""
        groups = of.groupBy("band").agg(F.count("*").alias("members")).filter("members > 1")
        return written(of.join(groups.hint("merge"), "band"), "bands")

    shared = shared_bands(keyed)
    held = shared.select("doc").distinct()
    sets = written(rows.join(held.hint("merge"), "doc", "left_semi").mapInArrow(
        collect, T.StructType([doc, T.StructField("set", T.BinaryType())])), "sets")

    def linked(pairs: DataFrame, name: str) -> DataFrame:
        """The near copies among (a, b, n, m), candidates with the sizes of their sets."""
        may = pairs.filter(F.least("n", "m") >= SIMILAR * F.greatest("n", "m")).select("a", "b").distinct()
        both = may.join(sets.select(F.col("doc").alias("a"), F.col("set").alias("s")).hint("merge"), "a").join(
            sets.select(F.col("doc").alias("b"), F.col("set").alias("t")).hint("merge"), "b").select("a", "b", "s", "t")
        return written(both.mapInArrow(verify, pair).distinct(), name)

    found = linked(paired(shared.filter(F.col("members") <= crowd)), "pairs")
    many = shared.filter(F.col("members") > crowd).select("doc", "n", "band", "members")
    some, paid = not many.isEmpty(), True
    while some and paid:
        near = linked(starred(many), "stars")
        found = found.unionByName(near)
        # the members of large bands that stand for their components
        roots = written(components(found), "roots")
        gone = roots.filter("node != root").select(F.col("node").alias("doc"))
        left = written(many.select("doc", "n", "band").join(gone.hint("merge"), "doc", "left_anti"), "left")
        before, after = (of.select("doc").distinct().count() for of in (many, left))
        many = shared_bands(left)
        paid = before - after >= PAYS * before
    if some:
        alone = left.select("doc", "n").distinct()
        tokens = alone.join(sets.hint("merge"), "doc").mapInArrow(
            spell, T.StructType([doc, T.StructField("n", T.LongType()), T.StructField("token", T.LongType())]))
        found = found.unionByName(linked(by_rarest(written(tokens, "tokens")), "rare"))
    roots = components(found)
    return roots.filter("node != root").select(F.col("node").alias(key)).distinct()
