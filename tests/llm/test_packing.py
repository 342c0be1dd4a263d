import itertools
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from gleanbase.llm import packing, tokens
from gleanbase.llm.queries import op5_packing, packed

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def tokenizer():
    return Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))


@pytest.fixture(scope="module")
def encode():
    return tokens.byte_bpe().load()


def check(rows, texts, tokenizer, length=2048):
    own = defaultdict(list)
    for r in rows:
        own[r.doc_id].append(r)
    assert set(own) == set(texts)
    for doc, text in texts.items():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        place = 0
        for k, r in enumerate(sorted(own[doc], key=lambda r: r.piece)):
            assert (r.piece, r.start) == (k, place)
            assert r.length == length or k == 0
            assert r.ids_crc32 == zlib.crc32(ids[place:place + r.length].tobytes())
            place += r.length
        assert place == len(ids)
    filled = defaultdict(list)
    for r in rows:
        filled[r.sequence_id].append((r.offset, r.length))
    for parts in filled.values():
        end = 0
        for offset, n in sorted(parts):
            assert offset == end
            end += n
        assert end <= length
    return len(filled), -(-sum(r.length for r in rows) // length)


def test_query(spark, tokenizer):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    used, least = check(op5_packing(spark, SF).collect(), texts, tokenizer)
    assert used <= 1.01 * least + 1


@settings(max_examples=150, deadline=None)
@given(st.text(alphabet=st.characters(exclude_categories=["Cs"]), max_size=60), st.text(max_size=5))
def test_both_libraries_give_the_same_ids(tokenizer, encode, text, end):
    for value in (text, f"{text}  {end}\n\n{text} ", f"{text}<|endoftext|>{end}"):
        assert encode(value) == tokenizer.encode(value, add_special_tokens=False).ids


def fewest(sizes, length):
    """Fewest sequences, by trying all."""
    best = len(sizes)

    def go(k, free):
        nonlocal best
        if len(free) >= best:
            return
        if k == len(sizes):
            best = len(free)
            return
        for j in range(len(free)):
            if free[j] >= sizes[k] and free[j] not in free[:j]:
                go(k + 1, [*free[:j], free[j] - sizes[k], *free[j + 1:]])
        go(k + 1, [*free, length - sizes[k]])

    go(0, [])
    return best


@settings(max_examples=300, deadline=None)
@given(st.lists(st.integers(1, 20), max_size=9))
def test_reduction_loses_nothing(sizes):
    fixed, left = packing.reduce(dict(Counter(sizes)), 20)
    rest = [s for s, n in left.items() for _ in range(n)]
    assert Counter(s for p, n in fixed for _ in range(n) for s in p) + Counter(rest) == Counter(sizes)
    assert all(sum(p) <= 20 for p, _ in fixed)
    sizes.sort(reverse=True)
    assert sum(n for _, n in fixed) + fewest(sorted(rest, reverse=True), 20) == fewest(sizes, 20)


@settings(max_examples=200, deadline=None)
@given(st.dictionaries(st.integers(1, 50), st.integers(1, 40), max_size=12))
def test_best_fit(counts):
    groups = packing.best_fit(counts, 50)
    assert Counter({s: 0 for s in counts}) + Counter(
        {s: sum(p.count(s) * n for p, n in groups) for s in counts}) == Counter(counts)
    assert all(n > 0 and 0 < sum(p) <= 50 for p, n in groups)
    free = []  # the plain form, piece by piece
    for size in sorted(itertools.chain(*([s] * n for s, n in counts.items())), reverse=True):
        fits = [k for k in range(len(free)) if free[k] >= size]
        if fits:
            free[min(fits, key=lambda k: free[k])] -= size
        else:
            free.append(50 - size)
    assert sum(n for _, n in groups) == len(free)


def test_many_pieces_make_a_short_plan():
    rng = random.Random(1)
    counts = {s: rng.randint(1, 10**9) for s in range(1, 2049)}
    made = packing.plan(counts, 2048)
    assert len(made.length) < 20_000
    total = sum(s * n for s, n in counts.items())
    assert made.sequences <= 1.01 * total / 2048


def test_small_salts(spark, tokenizer, frame, monkeypatch):
    monkeypatch.setattr(packing, "RANKED", 3)
    texts = {n: "word " * (n % 7) for n in range(100)}
    used, least = check(packed(frame(*texts.items())).collect(), texts, tokenizer)
    assert used == least


def test_sequences(spark, frame):
    docs = frame((1, "some words here"), (2, None), (3, "other words"), (4, "x" * 300))
    made = tokens.pieces(docs.select("doc_id", "text"), tokens.byte_bpe(), length=16).persist()
    rows = packing.sequences(packing.pack(made, length=16)).collect()
    assert all(4 * r.length == len(r.ids) and r.length <= 16 for r in rows)
    assert Counter(b"".join(r.ids for r in rows)) == Counter(b"".join(r.ids for r in made.collect()))
    made.unpersist()


def test_odd_rows(odd, empty, tokenizer):
    rows = packed(odd).collect()
    texts = odd.select("doc_id", "text").collect()
    want = Counter((d, len(tokenizer.encode(t or "", add_special_tokens=False).ids) + 1) for d, t in texts)
    got = Counter()
    for r in rows:
        got[r.doc_id] += r.length
    assert got == sum((Counter({d: n * k}) for (d, n), k in want.items()), Counter())
    assert len({(r.sequence_id, r.offset) for r in rows}) == len(rows)
    assert packed(empty).count() == 0
    with pytest.raises(ValueError):
        packing.pack(odd.selectExpr("doc_id", "1 AS piece", "5000 AS length"))
