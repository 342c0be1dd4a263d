import hashlib
import random
import re
import zlib
from fractions import Fraction

import numpy as np
import pytest

from gleanbase.llm import repeats
from gleanbase.llm.queries import op13_periodic_runs

SF = "/root/testdata/sf0.001"


def plain_lyndon(w):
    """A word is Lyndon if it is less than all its proper suffixes."""
    return [max(k for k in range(1, len(w) - i + 1) if all(w[i:i + k] < w[j:i + k] for j in range(i + 1, i + k)))
            for i in range(len(w))]


def plain_runs(w, least=6, times=4):
    """For each period the longest stretches that have it, unless they have a lesser one."""
    n, found = len(w), set()
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            if w[i] != w[i + q]:
                i += 1
                continue
            start = i
            while i < n - q and w[i] == w[i + q]:
                i += 1
            part = w[start:i + q]
            if len(part) >= max(least, times * q) and not any(part[d:] == part[:-d] for d in range(1, q)):
                found.add((start, len(part), q))
    return sorted(found, key=lambda r: (r[0], r[2]))


def texts(rng, n):
    """Words over few letters, with loops put in, also loops of loops."""
    letters = rng.choice([1, 2, 3, 8])
    w = [rng.randrange(letters) for _ in range(rng.randrange(n))]
    for _ in range(rng.randrange(4)):
        at, block = rng.randrange(len(w) + 1), [rng.randrange(letters) for _ in range(rng.randrange(1, 6))]
        w[at:at] = (block * rng.randrange(2, 9) + block[:rng.randrange(len(block))]) * rng.choice([1, 1, 4])
    return w


def numbered(w):
    return np.unique(np.array(w, np.int64), return_inverse=True)[1]


def test_lyndon_arrays():
    rng = random.Random(1)
    for _ in range(400):
        ids = numbered(texts(rng, 20))[:60].tolist()
        ids = numbered(ids).tolist()
        letters = max(ids, default=-1) + 1
        assert repeats.lyndon_array(ids, letters) == plain_lyndon(ids)
        back = [letters - 1 - x for x in ids]
        assert repeats.lyndon_array(back, letters) == plain_lyndon(back)


def test_runs():
    rng = random.Random(2)
    some = 0
    for _ in range(1500):
        w = texts(rng, 60)
        truth = plain_runs(w)
        assert repeats.runs(numbered(w)) == truth
        some += len(truth)
    assert some > 1000
    assert repeats.runs(numbered([])) == [] and repeats.runs(numbered([1] * 5)) == [] and repeats.runs(numbered([1] * 6)) == [(0, 6, 1)]


@pytest.mark.parametrize("n", [200_000])
def test_long_texts_take_linear_time(n):
    for w in ([0] * n, [k % 7 for k in range(n)], [k % (n // 5) for k in range(n)], list(range(n)), [bin(k).count("1") % 2 for k in range(n)]):
        for start, length, period in repeats.runs(numbered(w)):
            assert length >= max(6, 4 * period)
    a, b = [0], [0, 1]
    while len(b) < n:  # Fibonacci word: runs of all sizes, none of four periods
        a, b = b, b + a
    assert repeats.runs(numbered(b)) == []


def plain_rows(docs):
    out = {}
    for doc, text in docs:
        w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        n, h = len(w), zlib.crc32(str(doc).encode())
        g = h // 10
        if doc is not None and h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            w = w[:a] + [w[a + (i - a) % p] for i in range(a, n)]
        runs = plain_runs(w)
        drop = {i for s, length, q in runs for i in range(s + q, s + length)}
        best = min(runs, key=lambda r: (-Fraction(r[1], r[2]), r[0], r[2]), default=None)
        out[doc, text] = (doc, len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None,
                          hashlib.sha256("".join(f"{a},{b},{c}\n" for a, b, c in runs).encode()).hexdigest(),
                          hashlib.sha256(" ".join(x for i, x in enumerate(w) if i not in drop).encode()).hexdigest())
    return out


def test_query(spark):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect() if len(r.text or "") < 40_000]
    truth = plain_rows(docs)
    got = op13_periodic_runs(spark, SF)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    rows = {r.doc_id: tuple(r) for r in got.collect()}
    assert len(docs) > 150 and {d: rows[d] for d, _ in docs} == {d: truth[d, t] for d, t in docs}
    assert sum(r[1] > 0 for r in rows.values()) > 10


def test_odd_rows(spark, odd, empty, tmp_path):
    found = {(r.doc_id, r.text0): r for r in repeats.periodic_runs(odd.selectExpr("*", "text AS text0", "1 AS Runs")).collect()}
    assert len(found) == 10
    for (_, text), r in found.items():
        words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
        if len(words) < 1000:
            assert [tuple(x) for x in r.runs] == plain_runs(words)
        else:
            assert [tuple(x) for x in r.runs] == [(0, 160_000, 4)] and r.collapsed == "alpha beta gamma delta"
    assert repeats.periodic_runs(empty).columns == ["doc_id", "lang", "source", "n_chars", "runs", "collapsed"]
    assert repeats.periodic_runs(empty).count() == 0
    short = [(r.doc_id, r.text) for r in odd.collect() if len(r.text or "") < 1000]
    odd.filter("text IS NULL OR length(text) < 1000").write.parquet(f"{tmp_path}/documents.parquet")
    got = op13_periodic_runs(spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got), key=repr) == sorted((plain_rows([d])[d] for d in short), key=repr)
