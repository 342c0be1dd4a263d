import random
import re

import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanbase.llm import simhash
from gleanbase.llm.components import components
from gleanbase.llm.queries import op4_simhash

SF = "/root/testdata/sf0.01"


def plain_print(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return 0
    shingles = [" ".join(words[k:k + 3]) for k in range(max(1, len(words) - 2))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), seed=42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_components(prints):
    """(id, fingerprint) pairs to least id reachable, by comparing all."""
    root = list(range(len(prints)))

    def find(k):
        while root[k] != k:
            k = root[k]
        return k

    for a in range(len(prints)):
        for b in range(a):
            if (prints[a][1] ^ prints[b][1]).bit_count() <= 2:
                root[find(a)] = find(b)
    least = {}
    for k, (doc, _) in enumerate(prints):
        if doc is not None:
            least[find(k)] = min(doc, least.get(find(k), doc))
    return [least.get(find(k)) for k in range(len(prints))]


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want_prints = [(d.doc_id, plain_print(d.text)) for d in docs]
    want = {d: (f"{p:016x}", c) for (d, p), c in zip(want_prints, plain_components(want_prints))}
    got = {r.doc_id: (r.fingerprint, r.component_id) for r in op4_simhash(spark, SF).collect()}
    assert got == want


@settings(max_examples=100, deadline=None)
@given(st.lists(st.integers(0, 63), max_size=2), st.integers(0, 2**64 - 1))
def test_linked_prints_share_a_key(bits, value):
    other = value
    for b in bits:
        other ^= 1 << b

    def keys(x):
        return {(s, i, (x >> 32 * s & 0xFFFFFFFF) & ~(1 << i)) for s in (0, 1) for i in range(32)}

    assert keys(value) & keys(other)


@pytest.mark.parametrize("crowd", [1, 4, 16])
def test_links_whatever_the_crowd(spark, crowd):
    rng = random.Random(crowd)
    base = [rng.getrandbits(64) for _ in range(6)]
    prints = set(base)
    for b in base[:3]:  # families around a print, and chains away from it
        for _ in range(60):
            prints.add(b ^ 1 << rng.randrange(64) ^ 1 << rng.randrange(64))
    step = base[3]
    for k in range(30):
        step ^= 3 << 2 * k
        prints.add(step)
    signed = [p - (1 << 64) if p >> 63 else p for p in sorted(prints)]
    frame = spark.createDataFrame([(p,) for p in signed], "fp long")
    roots = {r.node: r.root for r in components(simhash.links(frame, crowd)).collect()}
    want = plain_components([(p, p & (1 << 64) - 1) for p in signed])
    assert [roots.get(p, p) for p in signed] == want


def test_components(spark):
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 400)] + [(7, 7), (None, 3), (500, 501), (501, 500)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {**{k: 0 for k in range(41)}, **{k: 100 for k in range(100, 400)}, 500: 500, 501: 500}
    assert components(spark.createDataFrame([], "a long, b long")).count() == 0


def test_odd_rows(odd, empty):
    rows = simhash.near_duplicates(odd).collect()
    texts = [(r.doc_id, r.text) for r in odd.select("doc_id", "text").collect()]
    want = plain_components([(d, plain_print(t)) for d, t in texts])
    assert sorted(map(repr, ((d, f"{plain_print(t):016x}", c) for (d, t), c in zip(texts, want)))) == \
        sorted(repr(tuple(r)) for r in rows)
    assert {r.component_id for r in rows if r.fingerprint == "0" * 16} == {1}
    assert simhash.near_duplicates(empty).count() == 0
