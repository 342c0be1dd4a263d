"""Spelling variants by PartEnum signatures of letter multisets.

A word is the set of its letters, each with the number of its occurrence (two a's are a1 and
a2): a binary vector. Words one insertion, deletion or replacement apart differ in at most
two places of it. Cut into ``PARTS`` parts, two vectors with at most two differences are equal
in all parts but two at least, so the parts are enumerated by all ways to leave two out, and
words that are near share a signature. The signature is taken together with a length and
with the first or last half of the word, as a single change leaves one of them whole; this
costs no pair either. Equal signatures are joined and each pair is verified by its edit
distance in the join.

The form of a word is its near word with the greatest count, if that is at least twice its
own; counts at least double along forms, so chains are short and are followed by doubling.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import written

PARTS = 5
APART = 2  # places in which the vectors of near words may differ
MIN_LETTERS, MIN_COUNT = 5, 3
RUN = f"[A-Za-zÀ-ÿ]{{{MIN_LETTERS},}}"  # shorter ones cannot become words
TIMES = 2  # a form is so many times as common
MISSPELT = 97  # one in so many (document, run) loses a letter
_HELD = 1 << 19  # words counted in a task before they go out
_PART = 1 << 20  # characters of a text looked at at once
_CHANGES = tuple(combinations(range(PARTS), PARTS - APART))
_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


def shortened(run: str, number: int) -> str:
    """The run, less one letter where the hash of its key and itself says so."""
    if number % MISSPELT:
        return run
    at = number % len(run)
    return run[:at] + run[at + 1:]


def word_counts(docs: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """(word, n): words of at least ``MIN_LETTERS`` letters met ``MIN_COUNT`` times or more in
    all texts. Runs are lower-cased in A-Z only, and some lose a letter by the hash of their
    document and themselves (a null key is written as nothing). Null and empty texts have no
    words; repeated rows count each."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs, ends, held = re.compile(RUN), re.compile("[^A-Za-zÀ-ÿ]"), Counter()

        def out() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())],
                                              ["word", "n"])
            held.clear()
            return made

        for batch in batches:
            for doc, value in zip(batch.column(0), batch.column(1)):
                name, text = doc.as_py(), value.as_py().translate(_LOWER)
                seed = zlib.crc32(f"{'' if name is None else name}:".encode("utf-8", "surrogatepass"))
                own: Counter = Counter()
                while text:  # a part of a long text at once, up to the end of a run
                    cut = ends.search(text, _PART) if len(text) > _PART else None
                    part, text = (text[:cut.start()], text[cut.start():]) if cut else (text, "")
                    own.update(runs.findall(part))
                for run, n in own.items():
                    word = shortened(run, zlib.crc32(run.encode("utf-8"), seed))
                    if len(word) >= MIN_LETTERS:
                        held[word] += n
                if len(held) >= _HELD:
                    yield out()
        if held:
            yield out()

    rows = docs.select(F.col(key).alias("doc"), F.col(text).alias("text")).filter("text IS NOT NULL")
    counts = rows.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counts.filter(F.col("n") >= MIN_COUNT)


def signatures(word: str, lengths: tuple[int, ...]) -> list[int]:
    """Keys of a word in pairs whose shorter word has one of the ``lengths``."""
    seen: dict[str, int] = {}
    parts: list[list[str]] = [[] for _ in range(PARTS)]
    for letter in word:
        seen[letter] = seen.get(letter, 0) + 1
        place = f"{letter}{seen[letter]}"
        parts[zlib.crc32(place.encode("utf-8", "surrogatepass")) % PARTS].append(place)
    whole = [" ".join(sorted(part)) for part in parts]
    left = ["|".join(f"{k}:{whole[k]}" for k in some).encode("utf-8", "surrogatepass") for some in _CHANGES]
    keys, digest = [], xxhash.xxh64_intdigest
    for length in lengths:
        half = length // 2
        for end in (f"{length}<{word[:half]}|", f"{length}>{word[len(word) - half:]}|"):
            start = end.encode("utf-8", "surrogatepass")
            keys += [digest(start + some) for some in left]
    return keys


def _signed(words: DataFrame, shorter: bool) -> DataFrame:
    """(word, n, key) of the words as the shorter of a pair or one of two of a length, or as
    the other."""
    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):  # short outputs, whatever the batch
                batch = whole.slice(start, 512)
                made = [signatures(w, (len(w),) if shorter else (len(w), len(w) - 1)) for w in batch.column(0).to_pylist()]
                at = pa.array([row for row, keys in enumerate(made) for _ in keys], pa.int64())
                keys = pa.array([key for keys in made for key in keys], pa.uint64()).view(pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(at), batch.column(1).take(at), keys], ["word", "n", "key"])

    return words.mapInArrow(sign, "word string, n long, key long")


def near_words(words: DataFrame) -> DataFrame:
    """(a, na, b, nb): all pairs of the distinct words (word, n) one change apart, each once."""
    # each word becomes 60 rows, so the words are dealt over all partitions, however few bytes they are
    dealt = words.select("word", "n").repartition(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), "word")
    x = _signed(dealt, True).selectExpr("key", "word AS a", "n AS na")
    y = _signed(dealt, False).selectExpr("key", "word AS b", "n AS nb")
    near = "(char_length(a) < char_length(b) OR char_length(a) = char_length(b) AND a < b) AND levenshtein(a, b, 1) = 1"
    # signatures grow with the words, so they are never broadcast
    return x.join(y.hint("merge"), "key").filter(near).select("a", "na", "b", "nb").distinct()


def group_variants(words: DataFrame) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of ``words`` (word, n), a written
    table of distinct words. Ties of the greatest count go to the least word by code points.
    ``root`` is the end of the chain of forms, the word itself if it has none."""
    pairs = near_words(words)
    both = pairs.selectExpr("a AS word", "na AS own", "b AS other", "nb AS n").unionByName(
        pairs.selectExpr("b AS word", "nb AS own", "a AS other", "na AS n"))
    best = F.min_by(F.struct("other", "n"), F.struct(-F.col("n"), "other"))
    found = written(both.groupBy("word", "own").agg(F.count("*").alias("n_near"), best.alias("best")).select(
        "word", "n_near", F.when(F.col("best.n") >= TIMES * F.col("own"), F.col("best")).alias("best")), "near")
    chain = written(found.filter("best IS NOT NULL").select("word", F.col("best.other").alias("root")), "forms")
    going = not chain.isEmpty()
    while going:  # twice as far along the chain with each round
        ahead = chain.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = written(chain.join(ahead.hint("merge"), "root", "left").select("word", F.coalesce("next", "root").alias("root"),
                                                                               F.col("next").isNotNull().alias("moved")), "forms")
        chain, going = step.select("word", "root"), not step.filter("moved").isEmpty()
    return words.join(found.hint("merge"), "word", "left").join(chain.hint("merge"), "word", "left").select(
        "word", F.col("best.other").alias("form"), F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.col("best.n").alias("form_n"))
