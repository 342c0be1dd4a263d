import hashlib
from collections import Counter

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from gleanbase.llm import rollup, sharding, tokens
from gleanbase.llm.queries import SHARDS, op9_token_counts, op10_sharding
from gleanbase.session import scratch_path

SF = "/root/testdata/sf0.001"
COUNTED = "source string, lang string, tokenizer string, n_tokens long"


def test_token_counts(spark):
    import base64
    import tiktoken
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    with open(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    second = tiktoken.Encoding("second", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    toxic = {r.doc_id for r in spark.read.parquet(f"{SF}/labels.parquet").filter("toxic = 1").collect()}
    want = Counter()
    for r in spark.read.parquet(f"{SF}/documents.parquet").collect():
        if r.doc_id in toxic:
            continue
        version, n = (("byte_bpe_50k", len(first.encode(r.text or "", add_special_tokens=False).ids)) if r.lang == "en"
                      else ("byte_bpe_multi_50k", len(second.encode_ordinary(r.text or ""))))
        want[r.source, r.lang, version, "docs"] += 1
        want[r.source, r.lang, version, "tokens"] += n
    got = Counter()
    for r in op9_token_counts(spark, SF).collect():
        got[r.source, r.lang, r.tokenizer, "docs"] = r.n_docs
        got[r.source, r.lang, r.tokenizer, "tokens"] = r.n_tokens
    assert got == want and toxic


def test_batches(spark):
    totals = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    old = spark.createDataFrame([("a", "en", "v1", 10), ("a", "en", "v1", 5), ("b", None, "v1", 7), (None, "fr", "v1", None)], COUNTED)
    new = spark.createDataFrame([("a", "en", "v2", 8)], COUNTED)
    part = old.filter("n_tokens = 10")
    totals.commit("one", rollup.inserts(old))
    totals.commit("two", rollup.revisions(part, new))
    want = [("a", "en", "v1", 1, 5), ("a", "en", "v2", 1, 8), ("b", None, "v1", 1, 7), (None, "fr", "v1", 1, 0)]
    for batch in (None, "one", "two"):
        if batch:
            totals.commit(batch, rollup.inserts(old) if batch == "one" else rollup.revisions(part, new))
        assert sorted(map(repr, map(tuple, totals.totals().collect()))) == sorted(map(repr, want))
    totals.commit("three", rollup.deletes(old.filter("source = 'b'")))
    assert len(totals.totals().collect()) == 3
    totals.commit("four", rollup.inserts(old.limit(0)))
    assert len(totals.totals().collect()) == 3
    with pytest.raises(ValueError):
        totals.commit("a/b", rollup.inserts(old))


def test_count_odd_rows(odd, empty):
    docs = odd.withColumn("some", odd.doc_id.isNotNull())
    rows = tokens.count_tokens(docs, {"n": (tokens.byte_bpe(), None), "m": (tokens.byte_bpe_multi(), "some")}).collect()
    assert len(rows) == odd.count()
    assert {r.n for r in rows if r.doc_id in (1, 2)} == {0} and {r.m for r in rows if r.doc_id is None} == {None}
    assert tokens.count_tokens(empty, {"n": (tokens.byte_bpe(), None)}).count() == 0


def plain_table(shards, slots):
    """Turns taken over whole permutations."""
    orders = [[(sharding._number(s, "first") % slots + j * (sharding._number(s, "step") % (slots - 1) + 1)) % slots
               for j in range(slots)] for s in shards]
    table = [None] * slots
    while None in table:
        for n, order in enumerate(orders):
            free = next((p for p in order if table[p] is None), None)
            if free is not None:
                table[free] = n
    return table


@pytest.mark.parametrize("slots", [2, 7, 101, 499])
def test_table(slots):
    names = [f"s{n}" for n in range(min(7, slots))]
    for k in range(1, len(names) + 1):
        table = sharding.lookup_table(names[:k], slots)
        assert table.tolist() == plain_table(names[:k], slots)
        sizes = np.bincount(table, minlength=k)
        assert sizes.max() - sizes.min() <= 1


def test_few_slots_move():
    names = [f"s{n}" for n in range(50)]
    before, after = sharding.lookup_table(names), sharding.lookup_table(names + ["new"])
    moved = (before != after).mean()
    assert moved < 0.06 and moved >= (after == 50).mean()
    with pytest.raises(ValueError):
        sharding.lookup_table(names, 100)
    with pytest.raises(ValueError):
        sharding.lookup_table(["a", "a"])


def test_query(spark):
    table = sharding.lookup_table(SHARDS)
    rows = op10_sharding(spark, "/root/testdata/sf0.01").collect()
    assert len(rows) == 1000
    for r in rows:
        assert r.slot == int(hashlib.md5(str(r.doc_id).encode()).hexdigest()[:15], 16) % sharding.SLOTS
        assert r.shard == SHARDS[table[r.slot]]


def test_written_shards(spark, odd, empty):
    placed = sharding.place(odd, ["a", "b"], slots=5)
    assert placed.count() == odd.count() and "shard" in placed.columns
    path = scratch_path(spark, "shards")
    sharding.write_shards(placed, path)
    again = spark.read.parquet(path)
    assert sorted(map(repr, ((r.doc_id, r.shard) for r in again.collect()))) == \
        sorted(map(repr, ((r.doc_id, r.shard) for r in placed.collect())))
    assert sharding.place(empty, ["a"]).count() == 0


def test_totals_before_any_commit(spark, tmp_path):
    totals = rollup.Rollup(spark, f"{tmp_path}/none").totals()
    assert totals.count() == 0 and set(rollup.KEYS) <= set(totals.columns)
