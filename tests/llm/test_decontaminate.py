import hashlib
import re
from collections import defaultdict

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from gleanbase.llm import decontaminate as dc
from gleanbase.llm.queries import op7_decontaminate

SF = "/root/testdata/sf0.01"


def words_of(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items):
    windows = defaultdict(set)
    for item, text in items:
        words = words_of(text)
        n = min(10, len(words))
        for p in range(len(words) - n + 1 if n else 0):
            windows[tuple(words[p:p + n])].add(item)
    lengths = {len(w) for w in windows}
    out = []
    for doc, text in docs:
        words, hit, found = words_of(text), set(), set()
        for n in lengths:
            for p in range(len(words) - n + 1):
                if (w := tuple(words[p:p + n])) in windows:
                    hit |= set(range(p, p + n))
                    found |= windows[w]
        names = sorted(str(i) for i in found if i is not None)
        out.append((doc, len(words), len(hit), names))
    return out


def test_query(spark):
    docs = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    items = [tuple(r) for r in spark.read.parquet(f"{SF}/benchmark.parquet").select("item_id", "text").collect()]
    want = {d: (n, h, len(i), hashlib.sha256(",".join(i).encode()).hexdigest(), h > 0) for d, n, h, i in plain(docs, items)}
    got = {r.doc_id: tuple(r)[1:] for r in op7_decontaminate(spark, SF).collect()}
    assert got == want and sum(w[4] for w in want.values()) > 3


def ours(docs, items):
    n_hit = F.aggregate("spans", F.lit(0), lambda n, s: n + s["end"] - s["start"])
    rows = dc.decontaminate(docs, items).select("doc_id", "n_words", n_hit.alias("h"), "items").collect()
    return sorted(map(repr, map(tuple, rows)))


@pytest.mark.parametrize("bits", [4, 26])
def test_short_and_repeated_items(spark, frame, monkeypatch, bits):
    monkeypatch.setattr(dc, "MAP_BITS", bits)  # a full map lets all windows through, with the same result
    ten = "one two three four five six seven eight nine ten"
    items = [(1, "Alpha"), (2, "beta, gamma"), (3, ten + " eleven"), (30, ten), (4, ""), (5, None), (6, "!!"),
             (7, "p q r s t u"), (None, "no item id"), (3, "again the same id"), (8, ten)]
    docs = [(1, "x ALPHA y beta; gamma alpha"), (2, f"start {ten} eleven end {ten}"), (3, ten[4:]), (4, "p q r s t"),
            (5, "o p q r s t u v p q r s t u p q r s t u"), (6, "no item id"), (7, "again the same id"), (8, ten + " alpha"),
            (9, "Ünïcode alphabet"), (10, None)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    assert ours(frame(*docs), bench) == sorted(map(repr, plain(docs, items)))


@settings(max_examples=200, deadline=None)
@given(st.integers(1, 12), st.lists(st.integers(0, 3), min_size=12, max_size=40), st.integers(0, 20))
def test_equal_windows_have_equal_prints(n, words, shift):
    hashes = (np.array(words, np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    prints = dc.window_prints(hashes, n)
    assert len(prints) == len(words) - n + 1
    alone = [dc.window_prints(hashes[p:p + n], n)[0] for p in range(len(prints))]
    assert alone == list(prints)


def test_odd_rows(odd, empty, spark):
    bench = spark.createDataFrame([(1, "two three", "x"), (2, "alpha beta gamma delta alpha", "y")], "item_id long, text string, doc_id string")
    texts = [tuple(r) for r in odd.select("doc_id", "text").collect() if r.doc_id != 4]
    got = ours(odd.filter("doc_id IS NULL OR doc_id != 4"), bench)
    assert got == sorted(map(repr, plain(texts, [(1, "two three"), (2, "alpha beta gamma delta alpha")])))
    long = dc.decontaminate(odd.filter("doc_id = 4"), bench).first()
    assert long.items == ["2"] and [tuple(s) for s in long.spans] == [(0, 159_997)]
    assert dc.decontaminate(empty, bench).count() == 0
    none = dc.decontaminate(odd, bench.limit(0)).collect()
    assert len(none) == len(texts) + 1 and not any(r.spans or r.items for r in none)
