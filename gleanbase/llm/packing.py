"""Packing of pieces into sequences: dominance reduction, then best fit.

Only the number of pieces of each length matters to the packing, and there are at most
``length`` of those numbers, so they are counted in Spark, and the plan is made of patterns
with multiplicities whatever the number of pieces. The pieces then take their places from
the plan by their rank among those of their length.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right, insort
from collections import defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended, fresh

Pattern = tuple[int, ...]  # lengths in one sequence
RANKED = 50_000  # pieces of a length that are ranked together


class _Sizes:
    """The lengths still to be placed, ascending, with their counts."""

    def __init__(self, counts: dict[int, int]):
        self.n = {s: c for s, c in counts.items() if c > 0}
        self.order = sorted(self.n)

    def take(self, size: int, count: int) -> None:
        self.n[size] -= count
        if not self.n[size]:
            del self.n[size]
            del self.order[bisect_left(self.order, size)]

    def least(self, used: dict[int, int], k: int) -> int | None:
        """Sum of the ``k`` smallest left besides ``used``; None if there are fewer."""
        total = 0
        for size in self.order:
            m = min(k, self.n[size] - used.get(size, 0))
            total, k = total + m * size, k - m
            if not k:
                return total
        return None

    def largest(self, room: int, used: dict[int, int]) -> int | None:
        """The largest left besides ``used`` that is no longer than ``room``."""
        for k in range(bisect_right(self.order, room) - 1, -1, -1):
            if self.n[self.order[k]] > used.get(self.order[k], 0):
                return self.order[k]
        return None


def _dominating(size: int, sizes: _Sizes, length: int) -> Pattern | None:
    """A set with a piece of ``size`` that dominates all others with it, if the tests find one.

    A set dominates another if the pieces of the other can be shared out among places of its
    pieces, as then they may be exchanged without more sequences.
    """
    room = length - size
    used = {size: 1}
    a = sizes.largest(room, used)
    if a is None:
        return (size,)  # nothing fits beside it
    two = sizes.least(used, 2)
    if a == room or two is None or two > room:
        return (size, a)  # one piece at most fits beside it, or one fits exactly
    three = sizes.least(used, 3)
    if three is None or three <= room:
        return None
    # two pieces at most fit: the largest, and one as large as any second piece could be
    used[a] = used.get(a, 0) + 1
    b = sizes.largest(room - a, used)
    used[a] -= 1
    second = sizes.largest(room // 2, used)
    if b is not None and second is not None and b >= second:
        return (size, a, b)
    return None


def reduce(counts: dict[int, int], length: int) -> tuple[list[tuple[Pattern, int]], dict[int, int]]:
    """Sets fixed by dominance, with multiplicities, and the counts that are left.

    Lengths are tried from the largest; as what is fixed leaves fewer small pieces, more may
    dominate, so passes go on until one fixes nothing.
    """
    sizes, fixed = _Sizes(counts), []
    changed = True
    while changed:
        changed = False
        for size in sorted(sizes.n, reverse=True):
            while size in sizes.n and (pattern := _dominating(size, sizes, length)):
                need: dict[int, int] = defaultdict(int)
                for s in pattern:
                    need[s] += 1
                times = min(sizes.n[s] // m for s, m in need.items())
                # fixing only takes pieces away, which leaves the tests above true for the next
                for s, m in need.items():
                    sizes.take(s, m * times)
                fixed.append((pattern, times))
                changed = True
    return fixed, sizes.n


def best_fit(counts: dict[int, int], length: int) -> list[tuple[Pattern, int]]:
    """Best-fit decreasing, equal pieces and equal sequences handled together."""
    bins: dict[int, list[tuple[Pattern, int]]] = {}  # by free room
    rooms: list[int] = []

    def put(room: int, pattern: Pattern, times: int) -> None:
        if room not in bins:
            bins[room] = []
            insort(rooms, room)
        bins[room].append((pattern, times))

    for size in sorted(counts, reverse=True):
        left = counts[size]
        while left:
            k = bisect_left(rooms, size)
            room = rooms[k] if k < len(rooms) else length
            if k < len(rooms):
                pattern, times = bins[room].pop()
                if not bins[room]:
                    del bins[room]
                    del rooms[k]
            else:
                pattern, times = (), -(-left // (length // size))
            each = room // size  # the tightest sequence takes as many as fit before the next
            full = min(times, left // each)
            if full:
                put(room - each * size, pattern + (size,) * each, full)
                left -= full * each
            if full < times:
                rest = 0
                if left:  # fewer than fill one more
                    put(room - left * size, pattern + (size,) * left, 1)
                    left, rest = 0, 1
                if pattern and times - full - rest:
                    put(room, pattern, times - full - rest)
    return [group for groups in bins.values() for group in groups]


@dataclass(frozen=True)
class Plan:
    """For each length the runs of ranks, ascending, and where they go."""

    length: np.ndarray
    first: np.ndarray  # rank of the run's first piece
    sequence: np.ndarray  # its sequence
    each: np.ndarray  # pieces of the run in one sequence
    offset: np.ndarray  # place of the first of them
    sequences: int


def plan(counts: dict[int, int], length: int) -> Plan:
    fixed, left = reduce(counts, length)
    rows, ranks, sequence = [], defaultdict(int), 0
    for pattern, times in fixed + best_fit(left, length):
        offset = 0
        pattern = tuple(sorted(pattern, reverse=True))
        for size in dict.fromkeys(pattern):
            each = pattern.count(size)
            rows.append((size, ranks[size], sequence, each, offset))
            ranks[size] += each * times
            offset += each * size
        sequence += times
    rows.sort()
    columns = np.array(rows, np.int64).reshape(-1, 5).T
    return Plan(*columns, sequences=sequence)


def pack(pieces: DataFrame, length: int = 2048, size: str = "length", order: tuple[str, ...] = ("doc_id", "piece"),
         into: tuple[str, str] = ("sequence_id", "offset")) -> DataFrame:
    """``pieces`` with the sequence of each and its place there, gapless from 0.

    ``pieces`` must be a written table with a ``size`` of 1 to ``length`` in each row. Pieces
    of one length take their places in the order of ``order`` and then of all other columns,
    so only rows equal in everything can change places. Columns named as ``into`` are
    replaced. An empty table gives an empty one.
    """
    pieces = pieces.drop(*[c for c in pieces.columns if c.lower() in into])
    names = pieces.columns
    salt, n, before, rank = fresh(pieces, "salt", "n", "before", "rank")
    sizes = {r[0]: r[1] for r in pieces.groupBy(size).count().collect()}  # at most ``length`` rows
    if not all(s is not None and 1 <= s <= length for s in sizes):
        raise ValueError(f"a piece must have 1 to {length} tokens")
    salts = max(1, -(-max(sizes.values(), default=0) // RANKED))
    made = plan(sizes, length)
    # plain arrays only: a class would need this package where they are read
    shared = pieces.sparkSession.sparkContext.broadcast((made.length, made.first, made.sequence, made.each, made.offset))

    salted = pieces.withColumn(salt, F.pmod(F.xxhash64(*order), F.lit(salts)).cast("int"))
    counts = salted.groupBy(F.col(size).alias("_size"), F.col(salt).alias("_salt")).agg(F.count("*").alias(n))
    upto = Window.partitionBy("_size").orderBy("_salt").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("_size", "_salt", F.coalesce(F.sum(n).over(upto), F.lit(0)).alias(before))
    rest = [c for c in names if c not in order and c != size]
    local = Window.partitionBy(size, salt).orderBy(*order, *rest)
    ranked = salted.withColumn(rank, F.row_number().over(local) - 1).join(
        counts, (F.col(size) == F.col("_size")) & (F.col(salt) == F.col("_salt")))
    ranked = ranked.select(*names, (F.col(rank) + F.col(before)).alias(rank))
    at = names.index(size)

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        length, first, sequence, many, offset = shared.value
        keys = length * (1 << 48) + first
        for batch in batches:
            sizes = batch.column(at).to_numpy(zero_copy_only=False).astype(np.int64)
            ranks = batch.column(len(names)).to_numpy(zero_copy_only=False)
            run = np.searchsorted(keys, sizes * (1 << 48) + ranks, side="right") - 1
            inside, each = ranks - first[run], many[run]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns[:-1], pa.array(sequence[run] + inside // each),
                 pa.array(offset[run] + inside % each * sizes)], [*names, *into])

    return ranked.mapInArrow(place, appended(pieces.schema, **{c: T.LongType() for c in into}))


def sequences(packed: DataFrame, ids: str = "ids") -> DataFrame:
    """(sequence_id, length, ids): the pieces of each sequence put together. A sequence is of
    bounded length, so a group is too."""
    parts = F.sort_array(F.collect_list(F.struct("offset", ids)))
    whole = F.aggregate(parts, F.lit(b""), lambda made, part: F.concat(made, part[ids]))
    return packed.groupBy("sequence_id").agg(F.sum("length").alias("length"), whole.alias("ids"))
