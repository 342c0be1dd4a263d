"""Periodic runs of words: stretches that repeat a period of words, as loops in texts do.

The root of a run is a Lyndon word in the order of words or in its reverse, and the longest
one that starts where it does. The first phase of a suffix sorter by grouping gives these
words directly: suffixes are kept in groups, ordered, each of which shares a Lyndon prefix;
groups are taken from the greatest down, and each lengthens the prefixes of the nearest
lesser suffixes before its members, which splits their groups. The prefix of a suffix is final
when its group is taken, so both Lyndon arrays (one for each order) come from it in time
linear in the words. Roots are then extended both ways by their longest common extensions.

Only stretches where each three words in a row are met three times in the text can hold a run
of four periods, and such a run lies in one of them, so the others are not sorted.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator
from itertools import count

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import appended

LEAST = 6  # words of a run,
TIMES = 4  # and periods


def lyndon_array(word: list[int], letters: int) -> list[int]:
    """Length of the longest Lyndon word from each place on. Words are numbers below
    ``letters``, and every number is among them."""
    n = len(word)
    group, length = list(word), [1] * letters
    members: list[list[int]] = [[] for _ in range(letters)]
    for i, w in enumerate(word):
        members[w].append(i)
    size = list(map(len, members))
    below, above = list(range(-1, letters - 1)), [*range(1, letters), -1]
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))  # nearest places not taken yet
    found, lesser = [0] * n, [-1] * n
    taken = letters - 1
    while taken >= 0:
        own, part = length[taken], [i for i in members[taken] if group[i] == taken]
        pointed: dict[int, int] = {}
        for i in part:
            j = left[i]
            if j >= 0 and group[j] == taken:
                j = lesser[j]
            lesser[i] = j
            if j >= 0:
                pointed[j] = pointed.get(j, 0) + 1
        for i in part:
            found[i] = own
            a, b = left[i], right[i]
            if a >= 0:
                right[a] = b
            if b < n:
                left[b] = a
        split: dict[tuple[int, int], list[int]] = {}
        for j, times in pointed.items():
            split.setdefault((times, group[j]), []).append(j)
        for times, old in sorted(split, reverse=True):  # more pointers make a greater group
            moved = split[times, old]
            if len(moved) == size[old]:
                length[old] += times * own
                continue
            new = len(members)
            members.append(moved)
            size.append(len(moved))
            size[old] -= len(moved)
            length.append(length[old] + times * own)
            after = above[old]
            below.append(old)
            above.append(after)
            above[old] = new
            if after >= 0:
                below[after] = new
            for j in moved:
                group[j] = new
        taken = below[taken]
    return found


def _common(a: np.ndarray, b: np.ndarray) -> int:
    """Length of the common prefix of two arrays of one length, in steps that double."""
    start, step = 0, 32
    while start < len(a):
        differ = np.flatnonzero(a[start:start + step] != b[start:start + step])
        if len(differ):
            return start + int(differ[0])
        start, step = start + step, 2 * step
    return len(a)


def _extended(word: np.ndarray, roots: np.ndarray) -> list[tuple[int, int, int]]:
    """Runs (start, length, period) around roots (period, start), sorted."""
    out = []
    n, period, end = len(word), 0, 0
    for p, i in roots.tolist():
        if p == period and i + p <= end:
            continue  # of the run before
        right = _common(word[i:n - p], word[i + p:])
        left = _common(word[:i][::-1], word[p:i + p][::-1])
        start, stop = i - left, i + p + right
        if stop - start >= max(LEAST, TIMES * p):
            out.append((start, stop - start, p))
            period, end = p, stop
    return out


def _stretches(ids: np.ndarray) -> list[tuple[int, int]]:
    """Where runs of ``TIMES`` periods may be: stretches of words in which each three in a row
    are met three times in the whole."""
    def long(mask: np.ndarray, least: int) -> list[tuple[int, int]]:
        edges = np.flatnonzero(np.diff(np.concatenate(([0], mask.astype(np.int8), [0]))))
        return [(a, b) for a, b in edges.reshape(-1, 2).tolist() if b - a >= least]

    if len(ids) < LEAST or not long(np.bincount(ids)[ids] >= TIMES, LEAST):
        return []
    pairs = np.unique(ids[:-1] * (int(ids.max()) + 1) + ids[1:], return_inverse=True)[1]
    _, which, counts = np.unique(pairs[:-1] * (int(ids.max()) + 1) + ids[2:], return_inverse=True, return_counts=True)
    return [(a, b + 2) for a, b in long(counts[which] >= 3, LEAST - 2)]


def runs(ids: np.ndarray) -> list[tuple[int, int, int]]:
    """(start, length, period) of all runs of ``LEAST`` words and ``TIMES`` periods or more,
    sorted by start and period. ``ids`` holds numbers from 0 without gaps that stand for words."""
    found = set()
    for a, b in _stretches(ids):
        letters, part = np.unique(ids[a:b], return_inverse=True)
        for order in (part, len(letters) - 1 - part):
            p = np.array(lyndon_array(order.tolist(), len(letters)))
            i = np.arange(len(part))
            some = i + 3 * p <= len(part)  # the first root in a run has three periods before the end
            p, i = p[some], i[some]
            for quarters in (0, 2, 4, 6, 8):  # of the first two periods: a look before roots are extended
                at = i + np.minimum(quarters * p // 4, 2 * p - 1)
                same = part[at] == part[at + p]
                p, i = p[same], i[same]
            roots = np.stack((p, i), axis=1)[np.lexsort((i, p))]
            found.update((start + a, length, period) for start, length, period in _extended(part, roots))
    return sorted(found, key=lambda run: (run[0], run[2]))


def looped(key: object, n: int) -> np.ndarray:
    """Places of the words of a text of ``n`` words whose end is made to repeat, by the hash
    of its key, in about one text of ten; all others, and those without a key, stay."""
    places = np.arange(n)
    number = zlib.crc32(str(key).encode("utf-8", "surrogatepass"))
    if key is not None and n and number % 10 == 0:
        part = number // 10
        a = part % n
        p = 1 + (n - a) // (3 + part % 8)
        places[a:] = a + (places[a:] - a) % p
    return places


def periodic_runs(docs: DataFrame, text: str = "text", key: str = "doc_id", loops: bool = False,
                  into: tuple[str, str] = ("runs", "collapsed")) -> DataFrame:
    """``docs`` with ``text`` replaced by its runs and by the text less their repeats.

    A run is a stretch of words that no neighbouring word extends with its least period, of at
    least ``LEAST`` words and ``TIMES`` periods: (start, length, period) in words from 0, sorted
    by start and period. The collapsed text has all words, joined by one space, but those that a
    run holds after its first period. Null and empty texts have no runs and collapse to ''.
    ``loops`` makes some texts repeat first, by the hash of ``key`` (see ``looped``). Each row is
    read alone; other columns pass through, and those named as ``into`` are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in into and c not in (key, text)])
    at, named = docs.columns.index(text), docs.columns.index(key)
    rest = [k for k in range(len(docs.columns)) if k != at]
    kind = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for first in range(0, whole.num_rows, 256):  # short outputs, whatever the batch
                batch, found, texts = whole.slice(first, 256), [], []
                for value, name in zip(batch.column(at), batch.column(named)):
                    words = (value.as_py() or "").encode("utf-8", "surrogatepass").split()  # ASCII separators only
                    number = defaultdict(count().__next__)
                    ids = np.fromiter(map(number.__getitem__, words), np.int64, len(words))
                    if loops:
                        places = looped(name.as_py(), len(words))
                        if len(places) and (places != np.arange(len(places))).any():
                            ids, words = ids[places], [words[k] for k in places.tolist()]
                            ids = np.unique(ids, return_inverse=True)[1]
                    own = runs(ids)
                    if own:
                        edge = np.zeros(len(words) + 1, np.int64)
                        for start, length, period in own:
                            edge[start + period] += 1
                            edge[start + length] -= 1
                        words = [words[k] for k in np.flatnonzero(np.cumsum(edge)[:-1] == 0).tolist()]
                    found.append([dict(zip(("start", "length", "period"), r)) for r in own])
                    texts.append(b" ".join(words).decode("utf-8", "surrogatepass"))
                yield pa.RecordBatch.from_arrays(
                    [*(batch.column(k) for k in rest), pa.array(found, kind), pa.array(texts, pa.string())],
                    [*(batch.schema.names[k] for k in rest), *into])

    each = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
    kept = T.StructType([docs.schema.fields[k] for k in rest])
    return docs.mapInArrow(run, appended(kept, **{into[0]: T.ArrayType(each), into[1]: T.StringType()}))
