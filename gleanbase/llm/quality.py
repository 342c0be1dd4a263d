"""Quality rules: counts of words, symbols and repetition, and bands of compression ratios.

A text passes when its zstandard ratio (compressed / raw bytes), whole and in fixed chunks,
lies in the band for its length. Below the band it repeats itself, above it it is noise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import appended

# Bands: from so many bytes on, the least and the greatest ratio. They are the outer
# thousandths of prose in four languages that passes the base rules, with a margin of a few
# hundredths; a frame header and the missing history weigh on short texts. Random digits
# compress like prose below some 8 kB, hexadecimal below 4 kB and single letters below 2 kB,
# so no ratio can tell them apart there.
BANDS = (
    (0, 0.40, 1.12),
    (128, 0.25, 0.98),
    (256, 0.25, 0.82),
    (512, 0.38, 0.72),
    (1024, 0.36, 0.63),
    (2048, 0.34, 0.57),
    (4096, 0.32, 0.52),
    (8192, 0.30, 0.482),
    (16384, 0.29, 0.45),
    (65536, 0.28, 0.44),
)
CHUNK = 4096  # bytes
BAD_CHUNKS = 0.5  # more of the chunks than this outside their band: rejected
WINDOW = 8  # words


def band(size: int) -> tuple[float, float]:
    return next((low, high) for least, low, high in reversed(BANDS) if size >= least)


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words inside windows that occur more than once in the text, all occurrences counted."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    numbers: dict[bytes, int] = {}
    ids = np.fromiter((numbers.setdefault(w, len(numbers)) for w in words), np.int64, len(words))
    if len(numbers) == len(words):
        return 0
    mixed = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    mixed ^= mixed >> np.uint64(29)
    key = np.zeros(n, np.uint64)
    for k in range(window):
        key = key * np.uint64(0xBF58476D1CE4E5B9) + mixed[k:k + n]
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    if not same.any():
        return 0
    first, second = order[:-1][same], order[1:][same]
    equal = np.ones(len(first), bool)
    for k in range(window):
        equal &= ids[first + k] == ids[second + k]
    if not equal.all():  # a chance meeting of two hashes: compare the windows themselves
        rows = np.lib.stride_tricks.sliding_window_view(ids, window)
        _, back, counts = np.unique(rows, axis=0, return_inverse=True, return_counts=True)
        hits = np.flatnonzero(counts[back.ravel()] > 1)
    else:
        hits = np.union1d(first, second)
    edge = np.zeros(len(words) + 1, np.int64)
    np.add.at(edge, hits, 1)
    np.add.at(edge, hits + window, -1)
    return int((np.cumsum(edge)[:-1] > 0).sum())


def repeated_lines(text: str) -> int:
    seen, again = set(), 0
    for line in text.split("\n"):
        if line.encode("utf-8", "surrogatepass").strip():  # strips the six ASCII separators only
            again += line in seen
            seen.add(line)
    return again


def ratios(data: bytes, press: zstandard.ZstdCompressor, chunk: int = CHUNK) -> tuple[float, float]:
    """Ratio of the whole, and the share of chunks outside their band. A rest of less than
    half a chunk goes with the chunk before it."""
    if not data:
        return 1.0, 0.0
    cuts = list(range(0, max(1, len(data) - chunk // 2), chunk))
    bad = 0
    for start, end in zip(cuts, [*cuts[1:], len(data)]):
        low, high = band(end - start)
        bad += not low <= len(press.compress(data[start:end])) / (end - start) <= high
    return len(press.compress(data)) / len(data), bad / len(cuts)


def measure(text: str | None, press: zstandard.ZstdCompressor) -> tuple:
    text = text or ""
    data = text.encode("utf-8", "surrogatepass")
    words = data.split()
    n_words = len(words)
    repeats = repeated_words(words)
    failed = n_words < 20 or 100 * repeats > 30 * n_words
    whole, bad = ratios(data, press)
    low, high = band(len(data))
    return (n_words, len(text) - sum(map(text.count, " \t\n\v\f\r")), sum(map(text.count, "#*$%&|<>")),
            repeated_lines(text), repeats, failed, not failed and low <= whole <= high and bad <= BAD_CHUNKS, whole, bad)


FIELDS = {
    "n_words": T.LongType(), "word_chars": T.LongType(), "n_symbols": T.LongType(), "n_dup_lines": T.LongType(),
    "n_repeat_words": T.LongType(), "base_failed": T.BooleanType(), "kept": T.BooleanType(),
    "zstd_ratio": T.DoubleType(), "bad_chunks": T.DoubleType(),
}


def judge(docs: DataFrame, text: str = "text", level: int = 3) -> DataFrame:
    """``docs`` with the counts, ratios and verdict of each whole text.

    Null and empty texts have no words and are not kept. Each row is judged alone, so
    repeated rows get equal answers. Columns that have a name of the result are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in FIELDS and c != text])
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=level)
        for batch in batches:
            rows = [measure(value.as_py(), press) for value in batch.column(place)]
            made = [pa.array([r[n] for r in rows], kind) for n, kind in enumerate(
                [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *made], [*batch.schema.names, *FIELDS])

    return docs.mapInArrow(run, appended(docs.schema, **FIELDS))
