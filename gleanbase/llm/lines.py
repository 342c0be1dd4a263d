"""Line dedup by winnowing over line hashes.

A window is the least run of lines, from any line on or up to any line, that has ``min_words``
words. The least line hash in it is its fingerprint, so a run of lines that repeats, in one
document or in two, and holds a window, selects the same fingerprint at every occurrence.
Fingerprints met once in the corpus are done with; where one is met again, the windows around
it that selected it are compared by the digests of their lines, which extends the match both
ways, and every occurrence of a window but the first loses its lines. Windows that start at
the lines of a run and the one that ends with it cover it, so a run of ``min_words`` words or
more that repeats is lost from end to end.

The first occurrence is that with the least (key, text hash, line). The first occurrence of
a line's words is never lost, since a window lost on its account would hold an earlier one.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator
from hashlib import md5

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..session import written
from .common import appended, fresh

MIN_WORDS = 50


def line_table(text: str | None) -> tuple[bytes, bytes]:
    """16-byte digests of the lines, and their numbers of words as 32-bit integers. Lines are
    compared by their words, whatever the space between; a line without words has zeros."""
    digests, counts = [], []
    for line in (text or "").encode("utf-8", "surrogatepass").split(b"\n"):
        words = line.split()
        digests.append(md5(b" ".join(words)).digest() if words else bytes(16))
        counts.append(len(words))
    return b"".join(digests), np.array(counts, "<i4").tobytes()


def windows(digests: bytes, counts: bytes, min_words: int) -> Iterator[tuple[int, int, int, int]]:
    """(fingerprint, its line, first line, line after the last) of each window, by start and
    end; numbers are those of the lines that have words."""
    words = np.frombuffer(counts, "<i4")
    prints = np.frombuffer(digests, "<i8")[::2][words > 0].tolist()
    total = np.concatenate(([0], np.cumsum(words[words > 0], dtype=np.int64)))
    lines = np.arange(len(total))
    ends = np.searchsorted(total, total[:-1] + min_words, side="left")  # of the windows from each line on
    starts = np.searchsorted(total, total[1:] - min_words, side="right") - 1  # of those up to each line
    inside, whole = ends < len(total), starts >= 0
    both = np.unique(np.concatenate((lines[:-1][inside] * len(total) + ends[inside],
                                     starts[whole] * len(total) + lines[1:][whole])))
    least: deque[int] = deque()
    reached = 0
    for start, end in zip((both // len(total)).tolist(), (both % len(total)).tolist()):  # neither ever falls
        while reached < end:
            while least and prints[least[-1]] >= prints[reached]:
                least.pop()
            least.append(reached)
            reached += 1
        while least[0] < start:
            least.popleft()
        yield prints[least[0]], least[0], start, end


def dedup_lines(docs: DataFrame, text: str = "text", key: str = "doc_id", min_words: int = MIN_WORDS,
                into: tuple[str, str] = ("n_lines", "n_removed")) -> DataFrame:
    """``docs`` with later repeats of runs of ``min_words`` words or more, in whole lines,
    taken out of ``text``, and with the numbers of lines it had and lost.

    Lines without words between lost lines go with them. A text that loses nothing is left
    as it is, null included (no lines); one that loses all becomes empty. Rows with equal key
    and text are one occurrence and get equal answers. Columns named as ``into`` are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in into and c not in (key, text)])
    rows = docs.select(F.col(key).alias("doc"), F.xxhash64(text).alias("th"), F.col(text).alias("text"))
    doc_type = rows.schema["doc"].dataType

    def tabulate(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [line_table(value.as_py()) for value in batch.column(2)]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array([m[0] for m in made], pa.binary()),
                 pa.array([m[1] for m in made], pa.binary())], ["doc", "th", "digests", "counts"])

    def select(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, prints, places = [], [], []
            for n, (digests, counts) in enumerate(zip(batch.column(2), batch.column(3))):
                for fp, place in {(fp, place) for fp, place, _, _ in windows(digests.as_py(), counts.as_py(), min_words)}:
                    which.append(n)
                    prints.append(fp)
                    places.append(place)
            index = pa.array(which, pa.int64())
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(index), batch.column(1).take(index), pa.array(prints, pa.int64()),
                 pa.array(places, pa.int32())], ["doc", "th", "fp", "place"])

    def extend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, made = [], []
            for n, (digests, counts, matched) in enumerate(zip(*batch.columns[2:])):
                digests, counts, matched = digests.as_py(), counts.as_py(), set(matched.as_py())
                filled = np.frombuffer(counts, "<i4") > 0
                packed = np.frombuffer(digests, "V16")[filled].tobytes()
                for _, place, start, end in windows(digests, counts, min_words):
                    if place in matched:
                        which.append(n)
                        made.append((md5(packed[16 * start:16 * end]).digest(), start, end))
            index = pa.array(which, pa.int64())
            columns = [pa.array([m[k] for m in made], kind) for k, kind in enumerate((pa.binary(), pa.int32(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(index), batch.column(1).take(index), *columns],
                                             ["doc", "th", "window", "start", "end"])

    def schema(**kinds: T.DataType) -> T.StructType:
        return T.StructType([T.StructField("doc", doc_type), T.StructField("th", T.LongType()),
                             *(T.StructField(n, k) for n, k in kinds.items())])

    table = written(rows.mapInArrow(tabulate, schema(digests=T.BinaryType(), counts=T.BinaryType())), "lines")
    prints = table.mapInArrow(select, schema(fp=T.LongType(), place=T.IntegerType()))
    again = written(prints.groupBy("fp").agg(F.count("*").alias("n")).filter("n > 1").select("fp"), "again")
    matched = prints.join(again, "fp").groupBy("doc", "th").agg(F.collect_set("place").alias("places"))
    near = table.alias("t").join(matched.alias("m"), F.expr("t.doc <=> m.doc AND t.th = m.th")).select("t.*", "m.places")
    found = written(near.mapInArrow(extend, schema(window=T.BinaryType(), start=T.IntegerType(), end=T.IntegerType())),
                    "windows")
    place = F.struct("doc", "th", "start")
    first = found.groupBy("window").agg(F.min(place).alias("first"), F.max(place).alias("last")).filter(
        "NOT (first <=> last)").select("window", "first")
    later = found.join(first, "window").filter("NOT (struct(doc, th, start) <=> first)")
    lost = written(later.groupBy("doc", "th").agg(F.collect_set(F.struct("start", "end")).alias("lost")), "lost")

    doc, th, runs = fresh(docs, "_doc", "_th", "_lost")
    lost = lost.select(F.col("doc").alias(doc), F.col("th").alias(th), F.col("lost").alias(runs))
    # what is lost grows with the corpus, so it is never broadcast
    both = docs.join(lost.hint("merge"), docs[key].eqNullSafe(lost[doc]) & (F.xxhash64(docs[text]) == lost[th]), "left").drop(doc, th)
    names = docs.columns
    at, width = names.index(text), len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, had, less = [], [], []
            for value, runs in zip(batch.column(at), batch.column(width)):
                kept, n, gone = without_runs(value.as_py(), runs.as_py())
                texts.append(kept)
                had.append(n)
                less.append(gone)
            columns = [*batch.columns[:at], pa.array(texts, pa.string()), *batch.columns[at + 1:width],
                       pa.array(had, pa.int64()), pa.array(less, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, [*names, *into])

    return both.mapInArrow(cut, appended(docs.schema, **{c: T.LongType() for c in into}))


def without_runs(text: str | None, runs: list | None) -> tuple[str | None, int, int]:
    """The text without the runs (numbers of lines with words), its lines, and those lost."""
    if text is None:
        return None, 0, 0
    lines = text.split("\n")
    if not runs:
        return text, len(lines), 0
    filled = [n for n, line in enumerate(lines) if line.encode("utf-8", "surrogatepass").split()]
    edge = np.zeros(len(lines) + 1, np.int64)
    for run in runs:
        edge[filled[run["start"]]] += 1
        edge[filled[run["end"] - 1] + 1] -= 1
    lost = np.cumsum(edge)[:-1] > 0
    for a, b in zip(filled, filled[1:]):  # empty lines between two lost runs
        if lost[a] and lost[b]:
            lost[a:b] = True
    kept = [line for line, gone in zip(lines, lost.tolist()) if not gone]
    if lost[filled].all():
        kept = []
    return "\n".join(kept), len(lines), len(lines) - len(kept)
