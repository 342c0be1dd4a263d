"""Text to vectors: one Arrow stage with a batch encoder loaded once per task."""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .spread import fill_cores, in_parts

DIM = 384  # fixed value: vector size of the collection
TEXTS = 512  # texts and vectors that a worker holds at once
Encoder = Callable[[list[str]], np.ndarray]

_WORD = re.compile(r"[^\W_]+")


class _Buckets(dict):
    """Bucket of each word met so far; emptied when it has grown large."""

    def __init__(self, dim: int, most: int = 100_000):
        super().__init__()
        self.dim, self.most = dim, most

    def __missing__(self, word: str) -> int:
        if len(self) >= self.most:
            self.clear()
        self[word] = bucket = int.from_bytes(hashlib.md5(word.encode()).digest()[:4]) % self.dim
        return bucket


class HashEncoder:
    """Lexical default: each word counts in the bucket md5(word)[:8 hex] mod dim, and the
    counts are scaled to unit length. A text without words gives the zero vector."""

    def __init__(self, dim: int = DIM):
        self.dim = dim
        self.buckets = _Buckets(dim)

    def __call__(self, texts: list[str]) -> np.ndarray:
        buckets, dim = self.buckets, self.dim
        out = np.zeros((len(texts), dim))
        for row, text in zip(out, texts):
            words = _WORD.findall(text.lower())
            row[:] = np.bincount(np.array([buckets[w] for w in words], np.int64), minlength=dim)
        length = np.sqrt((out * out).sum(axis=1, keepdims=True))
        return np.divide(out, length, out=out, where=length > 0)


def embed(df: DataFrame, text: str = "crawled_text", make_encoder: Callable[[], Encoder] = HashEncoder,
          dim: int = DIM, into: str = "embedding") -> DataFrame:
    """Add the vector of ``text``, the whole of it. Rows stay in their tasks; only an
    input smaller than a split per core is spread first.
    ``make_encoder`` runs in the task and gives a function from texts to a matrix, so a
    model is loaded where it is used."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = make_encoder()
        for batch in in_parts(batches, TEXTS):
            texts = [t or "" for t in batch.column(text).to_pylist()]
            matrix = np.asarray(encode(texts), dtype=np.float32)
            if matrix.shape != (len(texts), dim):
                raise ValueError(f"the encoder gave {matrix.shape}, not {(len(texts), dim)}")
            offsets = pa.array(np.arange(len(texts) + 1, dtype=np.int32) * dim)
            vectors = pa.ListArray.from_arrays(offsets, pa.array(matrix.ravel()))
            yield pa.RecordBatch.from_arrays([*batch.columns, vectors], [*batch.schema.names, into])

    df = fill_cores(df)
    schema = T.StructType([*df.schema.fields, T.StructField(into, T.ArrayType(T.FloatType()))])
    return df.mapInArrow(run, schema)
