"""Benchmark decontamination by winnowing.

A window is ten words of a benchmark item (the whole of a shorter item). Its fingerprint is
the least hash of the five-word grams in it (of all its words below five), so each window,
wherever it occurs, has the same fingerprint: no shared span of a window's length is missed.
Documents are winnowed in one pass; windows whose fingerprint may be a benchmark's go on
with their words, are joined to the benchmark on the fingerprint, and count if all their
words are equal, that is if the matched gram extends to the whole window on both sides.

A bit map of the benchmark's fingerprints, of bounded size, spares documents without any
from the join. It only ever lets too much through, so results do not depend on it.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

WINDOW, GRAM = 10, 5  # words
MAP_BITS = 26  # at most 8 MB
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
_MIX = np.uint64(0x9E3779B97F4A7C15)


def words_of(text: str | None) -> list[str]:
    return _WORD.findall((text or "").translate(_LOWER))


class _Hashes(dict):
    """Hash of each word met so far; emptied when it has grown large."""

    def __missing__(self, word: str) -> int:
        if len(self) >= 300_000:
            self.clear()
        self[word] = made = xxhash.xxh64_intdigest(word.encode("utf-8", "surrogatepass"))
        return made


def window_prints(hashes: np.ndarray, length: int, gram: int = GRAM) -> np.ndarray:
    """Fingerprint of the window of ``length`` words at each place."""
    gram = min(gram, length)
    n = len(hashes) - gram + 1
    if len(hashes) < length:
        return np.empty(0, np.uint64)
    made = np.full(n, length, np.uint64)
    for k in range(gram):
        made = (made ^ hashes[k:k + n]) * _MIX
        made ^= made >> np.uint64(31)
    least, places = made, len(hashes) - length + 1
    for k in range(1, length - gram + 1):
        least = np.minimum(least[:places], made[k:k + places])
    return least[:places]


def item_windows(items: DataFrame, text: str = "text", key: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(item, n, fp, words): the windows of every item."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _Hashes()
        for batch in batches:
            rows = []
            for item, value in zip(batch.column(0).to_pylist(), batch.column(1)):
                words = words_of(value.as_py())
                n = min(window, len(words))
                if n:
                    prints = window_prints(np.fromiter(map(known.__getitem__, words), np.uint64, len(words)), n)
                    rows += {(item, n, int(fp), " ".join(words[p:p + n])) for p, fp in enumerate(prints.view(np.int64))}
            columns = list(zip(*rows)) or [()] * 4
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(columns, (pa.string(), pa.int32(), pa.int64(), pa.string()))],
                ["item", "n", "fp", "words"])

    return items.select(F.col(key).cast("string"), F.col(text)).mapInArrow(
        run, "item string, n int, fp long, words string")


def print_map(prints: DataFrame, bits: int) -> np.ndarray:
    """Bit map of the fingerprints, two bits for each; at most 2**bits / 64 rows come back."""
    places = prints.select(F.explode(F.array(F.col("fp"), F.shiftrightunsigned("fp", 32))).alias("h")).select(
        F.col("h").bitwiseAND(F.lit((1 << bits) - 1)).alias("h"))
    words = places.groupBy(F.shiftrightunsigned("h", 6).alias("word")).agg(
        F.bit_or(F.expr("shiftleft(1L, CAST(h & 63 AS INT))")).alias("set")).toArrow()
    made = np.zeros(max(1, (1 << bits) >> 6), np.int64)
    made[words["word"].to_numpy()] = words["set"].to_numpy()
    return made.view(np.uint8)


def candidates(docs: DataFrame, lengths: list[int], bit_map: np.ndarray, bits: int, text: str, key: str) -> DataFrame:
    """(doc, n_words, found): of each document the windows that may be a benchmark's, each
    with all its places."""
    shared = docs.sparkSession.sparkContext.broadcast(bit_map)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, bit_map, mask = _Hashes(), shared.value, np.uint64((1 << bits) - 1)

        def maybe(prints: np.ndarray) -> np.ndarray:
            def isset(h: np.ndarray) -> np.ndarray:
                return (bit_map[h >> np.uint64(3)] >> (h & np.uint64(7)).astype(np.uint8) & 1).astype(bool)
            places = np.flatnonzero(isset(prints & mask))
            return places[isset(prints[places] >> np.uint64(32) & mask)]

        kind = pa.list_(pa.struct([("n", pa.int32()), ("fp", pa.int64()), ("words", pa.string()),
                                   ("places", pa.list_(pa.int32()))]))
        for whole in batches:
            for start in range(0, whole.num_rows, 256):  # short outputs, whatever the batch
                batch, counts, found = whole.slice(start, 256), [], []
                for value in batch.column(1):
                    words = words_of(value.as_py())
                    hashes = np.fromiter(map(known.__getitem__, words), np.uint64, len(words))
                    own: dict[tuple, list[int]] = {}
                    for n in lengths:
                        prints = window_prints(hashes, n)
                        for p in maybe(prints).tolist():
                            own.setdefault((n, int(prints[p:p + 1].view(np.int64)[0]), " ".join(words[p:p + n])), []).append(p)
                    counts.append(len(words))
                    found.append([(*window, places) for window, places in own.items()])
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0), pa.array(counts, pa.int64()), pa.array(
                        [[dict(zip(("n", "fp", "words", "places"), w)) for w in row] for row in found], kind)],
                    ["doc", "n_words", "found"])

    source = docs.select(F.col(key).alias("doc"), F.col(text).alias("text"))
    return source.mapInArrow(run, f"doc {source.schema['doc'].dataType.simpleString()}, n_words long, "
                                  "found array<struct<n: int, fp: long, words: string, places: array<int>>>")


def _spans(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Unites the windows of each document: (row, spans)."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))
    for batch in batches:
        made = []
        for row in batch.column(1).to_pylist():
            windows = np.array(sorted((p, p + w["n"]) for w in row for p in w["places"]))
            ends = np.maximum.accumulate(windows[:, 1])
            cuts = np.flatnonzero(windows[1:, 0] > ends[:-1]) + 1
            starts = windows[np.concatenate(([0], cuts)), 0]
            made.append([{"start": int(a), "end": int(b)} for a, b in zip(starts, ends[np.append(cuts - 1, len(ends) - 1)])])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, kind)], ["row", "spans"])


def decontaminate(docs: DataFrame, benchmark: DataFrame, text: str = "text", key: str = "doc_id",
                  item_text: str = "text", item_key: str = "item_id", window: int = WINDOW) -> DataFrame:
    """(key, n_words, spans, items) of every row of ``docs``.

    ``spans`` are the runs of words, by number, that lie in windows of the benchmark, in order
    and apart from each other; ``items`` the ids, as sorted strings, of the items with such
    windows. Both are empty where nothing was found, as for null and empty texts, and for
    all rows if the benchmark has no words. Items that repeat an id are one item; an item
    with a null id marks words but is not listed. Each row of ``docs`` is read alone.
    """
    known = written(item_windows(benchmark, item_text, item_key, window), "benchmark")
    windows = written(known.select("n", "fp", "words").distinct(), "windows")
    lengths = sorted(r[0] for r in windows.select("n").distinct().collect())  # at most ``window``
    bits = min(MAP_BITS, max(10, (16 * windows.count()).bit_length()))
    rows = written(candidates(docs, lengths, print_map(windows, bits), bits, text, key)
                   .withColumn("row", F.monotonically_increasing_id()), "candidates")  # the number is kept by writing it
    maybe = rows.filter(F.size("found") > 0).select("row", F.explode("found").alias("w")).select("row", "w.*")
    hits = written(maybe.join(windows, ["fp", "n", "words"]).select("row", "n", "fp", "words", "places"), "hits")
    spans = hits.groupBy("row").agg(F.collect_list(F.struct("n", "places")).alias("all")).mapInArrow(
        _spans, "row long, spans array<struct<start: int, end: int>>")
    items = hits.join(known.filter(F.col("item").isNotNull()), ["fp", "n", "words"]).select("row", "item").distinct()
    items = items.groupBy("row").agg(F.array_sort(F.collect_list("item")).alias("items"))
    none, nothing = F.array().cast("array<struct<start: int, end: int>>"), F.array().cast("array<string>")
    return (rows.select("row", "doc", "n_words").join(spans, "row", "left").join(items, "row", "left").select(
        F.col("doc").alias(key), "n_words", F.coalesce("spans", none).alias("spans"),
        F.coalesce("items", nothing).alias("items")))
