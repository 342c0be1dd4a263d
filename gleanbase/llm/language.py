"""Language identification: multinomial naive Bayes over hashed character n-grams.

A text is lower-cased; each run of characters that are not letters is one mark; n-grams of
one to three marks and letters are hashed to a fixed number of buckets. Training counts
buckets per label in each task and adds the counts up; the matrix of log probabilities
(labels x buckets, both bounded) is broadcast, and a batch of texts is scored as the
product of its sparse count rows and that matrix.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import appended

UNKNOWN = "und"
SLICE = 1 << 19  # characters handled at once, so that a long text needs no long arrays
CELLS = 1 << 21  # (bucket, label) cells scored at once


@dataclass(frozen=True)
class Model:
    labels: list[str]
    log_prior: np.ndarray  # per label
    log_prob: np.ndarray  # buckets x labels
    bits: int


class Grams:
    """Bucket counts of texts."""

    def __init__(self, bits: int):
        self.bits = bits
        self.letter = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)

    def _marks(self, text: str) -> np.ndarray:
        codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), "<u4")
        codes = np.where(self.letter[codes], codes, 0)
        if len(codes) > 1:
            codes = codes[np.concatenate(([True], (codes[1:] != 0) | (codes[:-1] != 0)))]
        return codes

    def counts(self, text: str | None) -> tuple[np.ndarray, np.ndarray] | None:
        """Filled buckets and their counts; None without a letter."""
        if not text:
            return None
        total, tail, letters = np.zeros(1 << self.bits, np.int64), np.zeros(1, np.uint32), False
        for start in range(0, len(text), SLICE):
            marks = self._marks(text[start:start + SLICE])
            letters = letters or bool(marks.any())
            if not tail[-1] and len(marks) and not marks[0]:
                marks = marks[1:]  # of one run of other characters, wherever the text was sliced
            if start + SLICE >= len(text) and (marks[-1] if len(marks) else tail[-1]):
                marks = np.append(marks, np.uint32(0))
            known = len(tail)  # marks of the slice before: only n-grams that end after them are new
            marks = np.concatenate((tail, marks)).astype(np.uint32)
            gram = np.zeros(len(marks), np.uint32)
            for n in (1, 2, 3):
                gram = gram[:len(marks) - n + 1] * np.uint32(0x01000193) + marks[n - 1:] + np.uint32(n)
                new = gram[max(0, known - n + 1):]
                mixed = (new ^ (new >> np.uint32(15))) * np.uint32(0x9E3779B1)
                total += np.bincount(mixed >> np.uint32(32 - self.bits), minlength=len(total))
                if n == len(marks):
                    break
            tail = marks[-2:]
        if not letters:
            return None
        filled = np.flatnonzero(total)
        return filled, total[filled]


def _quota(sizes: list[int], total: int) -> float:
    """The greatest size at which the sizes, each cut to it, are no more than ``total`` in all."""
    left, sizes = total, sorted(sizes)
    for n, size in enumerate(sizes):
        if size * (len(sizes) - n) > left:
            return left / (len(sizes) - n)
        left -= size
    return float("inf")


def train(docs: DataFrame, text: str = "text", label: str = "lang", key: str = "doc_id", *,
          max_rows: int = 200_000, bits: int = 15, smoothing: float = 0.5) -> Model:
    """Fit on the rows with a label and a text.

    Bound of the fit: about ``max_rows`` rows. Where there are more, each label has the same
    most number of rows, taken by the hash of ``key``; rarer labels are taken whole. Every
    label is learned: the model has 2^bits numbers for each, and labels are languages, of which
    there are thousands at most. Priors come from all rows. Without any labelled row the model
    has no label, and every text is unknown.
    """
    rows = docs.select(F.col(key).alias("k"), F.col(label).cast("string").alias("label"), F.col(text).alias("text"))
    rows = rows.filter(F.col("label").isNotNull() & F.col("text").isNotNull())
    size = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row for each label
    labels = sorted(size)
    most = _quota(list(size.values()), max_rows)
    if any(n > most for n in size.values()):
        rest = {name: int(most / n * (1 << 20)) for name, n in size.items() if n > most}
        cut = F.create_map(*(F.lit(x) for pair in rest.items() for x in pair))[F.col("label")]
        rows = rows.filter(cut.isNull() | (F.pmod(F.xxhash64("k"), F.lit(1 << 20)) < cut))
    order = {name: n for n, name in enumerate(labels)}

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        grams, sums = Grams(bits), {}
        for batch in batches:
            for name, value in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                if name in order and (found := grams.counts(value)):
                    own = sums.setdefault(order[name], np.zeros(1 << bits, np.int64))
                    own[found[0]] += found[1]
        for number, own in sums.items():
            filled = np.flatnonzero(own)
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(len(filled), number, np.int32)), pa.array(filled.astype(np.int32)),
                 pa.array(own[filled])], ["label", "bucket", "n"])

    made = rows.select("label", "text").mapInArrow(count, "label int, bucket int, n long")
    # at most labels x buckets rows
    sums = made.groupBy("label", "bucket").agg(F.sum("n").alias("n")).toArrow()
    matrix = np.full((1 << bits, len(labels)), smoothing)
    matrix[sums["bucket"].to_numpy(), sums["label"].to_numpy()] += sums["n"].to_numpy()
    log_prob = np.log(matrix) - np.log(matrix.sum(axis=0)) if labels else matrix
    prior = np.array([size[name] for name in labels], float)
    return Model(labels, np.log(prior / prior.sum()) if labels else prior, log_prob, bits)


def predict(docs: DataFrame, model: Model, text: str = "text", into: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the likeliest label of each whole text and its posterior probability.

    A null text, one without a letter, or a model without labels gives ``und`` and 0.0. Of
    equally likely labels the first by name is taken. Only the text is looked at, so equal
    texts get equal answers; other columns pass through, and those named as ``into`` are replaced.
    """
    docs = docs.drop(*[c for c in docs.columns if c.lower() in into and c != text])
    labels, bits = model.labels, model.bits
    # plain values only: a class would need this package where they are read
    shared = docs.sparkSession.sparkContext.broadcast((model.log_prior, model.log_prob))
    place = docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        log_prior, log_prob = shared.value
        grams, width = Grams(bits), max(1, len(labels))
        for batch in batches:
            names, scores = np.full(batch.num_rows, -1), np.zeros(batch.num_rows)
            which, rows, cells = [], [], 0

            def score() -> None:
                buckets = np.concatenate([r[0] for r in rows])
                counts = np.concatenate([r[1] for r in rows])
                starts = np.cumsum([0, *(len(r[0]) for r in rows[:-1])])
                sums = np.add.reduceat(counts[:, None] * log_prob[buckets], starts, axis=0) + log_prior
                best = sums.argmax(axis=1)
                names[which] = best
                scores[which] = 1 / np.exp(sums - sums.max(axis=1, keepdims=True)).sum(axis=1)

            for n, value in enumerate(batch.column(place)):
                found = grams.counts(value.as_py()) if labels else None
                if found:
                    which.append(n)
                    rows.append(found)
                    cells += len(found[0]) * width
                if cells >= CELLS:
                    score()
                    which, rows, cells = [], [], 0
            if rows:
                score()
            answer = pa.array([labels[k] if k >= 0 else UNKNOWN for k in names], pa.string())
            yield pa.RecordBatch.from_arrays([*batch.columns, answer, pa.array(scores)],
                                             [*batch.schema.names, *into])

    return docs.mapInArrow(run, appended(docs.schema, **{into[0]: T.StringType(), into[1]: T.DoubleType()}))


def fold(key: str = "doc_id", folds: int = 5) -> Column:
    """Fold of a row by its id; null for a null id."""
    return F.crc32(F.col(key).cast("string").cast("binary")) % folds
