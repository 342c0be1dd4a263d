import random
import re
import zlib
from collections import Counter, defaultdict

import pytest

from gleanbase.llm import spelling
from gleanbase.llm.queries import op12_spelling_variants

SF = "/root/testdata/sf0.001"


def plain_counts(docs):
    n = Counter()
    for doc, text in docs:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc is None else doc}:{run}".encode())
            if h % 97 == 0:
                run = run[:h % len(run)] + run[h % len(run) + 1:]
            n[run] += 1
    return {w: k for w, k in n.items() if len(w) >= 5 and k >= 3}


def one_apart(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:k] + b[k + 1:] == a for k in range(len(b)))


def plain_groups(n):
    """By comparing each word with all that a change of one letter could give."""
    near = defaultdict(set)
    places = defaultdict(set)
    for w in n:
        for k in range(len(w) + 1):
            places[w[:k], w[k:]].add(w)
            if k < len(w):
                places[w[:k], w[k + 1:]].add(w)
    for group in places.values():
        for a in group:
            near[a] |= {b for b in group if a != b and one_apart(a, b)}
    form = {}
    for w in n:
        best = min(near[w], key=lambda o: (-n[o], o), default=None)
        form[w] = best if best is not None and n[best] >= 2 * n[w] else None

    def root(w):
        while form[w] is not None:
            w = form[w]
        return w

    return {w: (w, form[w], root(w), n[w], len(near[w]), n.get(form[w])) for w in n}


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    truth = plain_groups(plain_counts(docs))
    got = op12_spelling_variants(spark, SF)
    assert got.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    assert {r.word: tuple(r) for r in got.collect()} == truth
    assert len(truth) > 1000 and sum(t[1] is not None for t in truth.values()) > 20


@pytest.mark.parametrize("letters", ["ab", "abcé", "abcdefghÿ×"])
def test_no_near_pair_is_lost(spark, letters):
    rng = random.Random(len(letters))
    words = list({"".join(rng.choices(letters, k=rng.randrange(1, 9))) for _ in range(400)})
    words += [w for w in {"a" * k for k in range(20, 24)} | {"a" * 30 + "b", "ab" * 15} if w not in words]
    df = spark.createDataFrame([(w, rng.randrange(1, 50)) for w in words], "word string, n long").repartition(4)
    found = spelling.near_words(df).collect()
    truth = {frozenset((a, b)) for a in words for b in words if a < b and one_apart(a, b)}
    assert {frozenset((r.a, r.b)) for r in found} == truth and len(found) == len(truth)


def test_chains_and_ties(spark):
    n = {"aaaaaa": 1, "aaaaab": 2, "aaaabb": 4, "aaabbb": 8, "aabbbb": 16, "abbbbb": 32, "bbbbbb": 64, "zzzzz": 9, "zzzzzy": 18,
         "zzzzzx": 18, "zzzzx": 17, "alone": 5}
    df = spark.createDataFrame(list(n.items()), "word string, n long")
    assert {r.word: tuple(r) for r in spelling.group_variants(df).collect()} == plain_groups(n)


def test_long_texts_in_parts(frame, monkeypatch):
    docs = [(1, "Words " * 50 + "Étéwords-letters " * 40), (2, "x" * 300), (3, "words" * 30)]
    whole = {r.word: r.n for r in spelling.word_counts(frame(*docs)).collect()}
    monkeypatch.setattr(spelling, "_PART", 7)
    assert {r.word: r.n for r in spelling.word_counts(frame(*docs)).collect()} == whole == plain_counts(docs)


def test_odd_rows(spark, odd, empty, tmp_path):
    docs = [(r.doc_id, r.text) for r in odd.collect()]
    counts = {r.word: r.n for r in spelling.word_counts(odd).collect()}
    assert counts == plain_counts(docs) and "alpha" in counts
    assert spelling.word_counts(empty).count() == 0
    empty.write.parquet(f"{tmp_path}/documents.parquet")
    assert op12_spelling_variants(spark, str(tmp_path)).collect() == []
    odd.write.parquet(f"{tmp_path}/odd/documents.parquet")
    assert {r.word: tuple(r) for r in op12_spelling_variants(spark, f"{tmp_path}/odd").collect()} == plain_groups(counts)
