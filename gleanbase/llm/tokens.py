"""Token ids of whole texts by public byte-level BPE vocabularies."""

from __future__ import annotations

import base64
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import public_tokenizers
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from tokenizers import Tokenizer

from .common import appended, others

END = "<|endoftext|>"


@dataclass(frozen=True)
class Encoder:
    """A vocabulary by the path of its rank file, and of its ``tokenizers`` file if it has one.

    The rank file gives the same ids several times faster; a text that holds the name of the
    special token, of which the two libraries have their own ideas, goes to ``tokenizers``.
    """

    ranks: str
    json: str | None = None

    def load(self):
        with open(self.ranks, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        plain = tiktoken.Encoding("ranks", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        full = Tokenizer.from_file(self.json) if self.json else None

        def encode(text: str) -> list[int]:
            if full is not None and END in text:
                return full.encode(text, add_special_tokens=False).ids
            return plain.encode_ordinary(text)

        return encode


def byte_bpe() -> Encoder:
    return Encoder(public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.path("byte_bpe_50k.json"))


def byte_bpe_multi() -> Encoder:
    return Encoder(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))


def count_tokens(docs: DataFrame, counts: dict[str, tuple[Encoder, str | None]], text: str = "text") -> DataFrame:
    """``docs`` with ``text`` replaced by token counts: a column for each entry of ``counts``,
    which gives its encoder and the name of a boolean column that says for which rows it is
    wanted (null elsewhere; None: all rows). A null text has no tokens. Columns named like an
    entry are replaced."""
    place = docs.columns.index(text)
    wanted = {into: docs.columns.index(where) if where else None for into, (_, where) in counts.items()}
    rest = others(docs, place, *counts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoders = {into: made.load() for into, (made, _) in counts.items()}
        for batch in batches:
            columns = {into: [] for into in counts}
            for n in range(batch.num_rows):
                value = batch.column(place)[n].as_py() or ""
                for into, encode in encoders.items():
                    where = wanted[into]
                    columns[into].append(len(encode(value)) if where is None or batch.column(where)[n].as_py() else None)
            made = [pa.array(values, pa.int64()) for values in columns.values()]
            yield pa.RecordBatch.from_arrays([*(batch.column(k) for k in rest), *made],
                                             [*(batch.schema.names[k] for k in rest), *columns])

    kept = T.StructType([docs.schema.fields[k] for k in rest])
    return docs.mapInArrow(run, appended(kept, **{into: T.LongType() for into in counts}))


def pieces(docs: DataFrame, encoder: Encoder, text: str = "text", length: int = 2048, end: int = 0) -> DataFrame:
    """One row per piece: the other columns of ``docs``, piece, start, length, ids.

    A document is the ids of its whole text (null: none) and ``end``. Only one longer than
    ``length`` is cut: full pieces, with what is over in the first. ``ids`` holds unsigned
    32-bit little-endian numbers. Columns named like these four are replaced.
    """
    place = docs.columns.index(text)
    fields = {"piece": T.IntegerType(), "start": T.LongType(), "length": T.LongType(), "ids": T.BinaryType()}
    rest = others(docs, place, *fields)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder.load()
        for batch in batches:
            for first in range(0, batch.num_rows, 256):  # short outputs, whatever the batch
                part = batch.slice(first, 256)
                rows, made = [], []
                for n, value in enumerate(part.column(place)):
                    ids = np.array([*encode(value.as_py() or ""), end], "<u4")
                    cut = len(ids) % length or length
                    bounds = [0, *range(cut, len(ids) + 1, length)] if len(ids) > length else [0, len(ids)]
                    for piece, (a, b) in enumerate(zip(bounds, bounds[1:])):
                        rows.append(n)
                        made.append((piece, a, b - a, ids[a:b].tobytes()))
                kept = [part.column(k).take(pa.array(rows, pa.int64())) for k in rest]
                new = [pa.array([m[k] for m in made], kind) for k, kind in enumerate(
                    (pa.int32(), pa.int64(), pa.int64(), pa.binary()))]
                yield pa.RecordBatch.from_arrays([*kept, *new], [*(part.schema.names[k] for k in rest), *fields])

    kept = T.StructType([docs.schema.fields[k] for k in rest])
    return docs.mapInArrow(run, appended(kept, **fields))


def checksum(ids: str = "ids"):
    return F.crc32(F.col(ids))
