import random
import re

import pytest

import corpus_pipeline
from gleanbase.llm import copies

SF = "/root/testdata/sf0.01"


def plain_set(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[k:k + 5]) for k in range(max(1, len(words) - 4))} if words else set()


def plain_pairs(docs):
    """Pairs of ids at similarity 0.8 or more, by comparing all."""
    sets = sorted(((d, plain_set(t)) for d, t in docs if d is not None), key=lambda x: len(x[1]))
    out = set()
    for k, (b, y) in enumerate(sets):
        for a, x in reversed(sets[:k]):
            if len(x) < 0.8 * len(y):
                break
            if a != b and x and len(x & y) >= 0.8 * len(x | y):
                out.add((min(a, b), max(a, b)))
    return out


def test_stage_leaves_no_near_copies(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    before = plain_pairs([(r.doc_id, r.text) for r in docs.collect()])
    left = corpus_pipeline.drop_near_duplicates(spark, docs, SF).collect()
    assert len(before) > 70 and not plain_pairs([(r.doc_id, r.text) for r in left])
    assert {a for a, _ in before} - {b for _, b in before} <= {r.doc_id for r in left}


@pytest.mark.parametrize("crowd", [1, 4, 16])
def test_crowds(frame, crowd):
    rng = random.Random(crowd)
    docs = []
    for family in range(6):
        base = [f"f{family}w{k}" for k in range(200)]
        for _ in range(40):
            words = list(base)
            for _ in range(rng.choice([0, 1, 2, 3, 5, 9])):
                words[rng.randrange(200)] = f"x{rng.random()}"
            docs.append((len(docs), " ".join(words)))
    docs += [(None, docs[0][1]), (1000, ""), (1001, None), (1002, "two words"), (1003, "Two  words"), (1003, docs[7][1])]
    gone = {r.doc_id for r in copies.near_copies(frame(*docs), crowd=crowd).collect()}
    pairs = plain_pairs(docs)
    ids = {d for d, _ in docs if d is not None}
    assert not {(a, b) for a, b in pairs if a not in gone and b not in gone}
    root = {d: d for d in ids}
    for _ in ids:
        for a, b in pairs:
            root[a] = root[b] = min(root[a], root[b])
    assert gone <= {d for d in ids if root[d] != d} and ids - gone >= {1000, 1001}


def test_odd_rows(odd, empty):
    assert {r.doc_id for r in copies.near_copies(odd).collect()} == set()
    assert copies.near_copies(empty).count() == 0


def families(rng, size, changes):
    base = [rng.randrange(1000) for _ in range(200)]
    for _ in range(size):
        words = list(base)
        for k in rng.sample(range(200), changes):
            words[k] = rng.randrange(1000)
        yield {hash(tuple(words[k:k + 5])) for k in range(196)}


def rarest(spark, sets):
    rows = [(n, len(s), token) for n, s in enumerate(sets) for token in s]
    return copies.by_rarest(spark.createDataFrame(rows, "doc long, n long, token long"))


@pytest.mark.parametrize("size", [200, 400, 800])
def test_texts_that_are_no_copies_make_few_candidates(spark, size):
    sets = list(families(random.Random(size), size, 6))  # alike, at about 0.58
    some = [len(a & b) / len(a | b) for a, b in zip(sets, sets[1:])]
    assert 0.5 < sum(some) / len(some) < 0.66
    assert rarest(spark, sets).count() <= size


def test_candidates_by_rarest_shingles_miss_no_pair(spark):
    rng = random.Random(4)
    sets = [s for changes in (1, 2, 3) for s in families(rng, 40, changes)]
    sets += [set(rng.sample(range(40), rng.randrange(1, 30))) for _ in range(150)]
    truth = {(a, b) for b in range(len(sets)) for a in range(b) if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b])}
    found = {(min(r.a, r.b), max(r.a, r.b)) for r in rarest(spark, sets).collect()}
    assert len(truth) > 500 and truth <= found
