import binascii

import numpy as np
import pytest

from gleanbase.llm import language
from gleanbase.llm.queries import op1_language

SF = "/root/testdata/sf0.01"


def test_query_on_held_out_documents(spark):
    rows = op1_language(spark, SF).collect()
    truth = {r.doc_id: r for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert len(rows) == len(truth)
    for r in rows:
        assert r.held_out == (binascii.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert 0 <= r.score <= 1
    held = [r for r in rows if r.held_out and truth[r.doc_id].lang]
    right = sum(r.lang_pred == truth[r.doc_id].lang for r in held)
    assert len(held) > 100 and right / len(held) > 0.98


def test_counts_do_not_depend_on_slices(monkeypatch):
    text = "Ünder the bridge,  il y a 12 poissons -- " * 30
    grams = language.Grams(10)
    whole = grams.counts(text)
    assert whole[1].sum() > 2 * len(text) // 2
    for size in (1, 2, 3, 7, 64):
        monkeypatch.setattr(language, "SLICE", size)
        marks = "".join(text[k:k + size] for k in range(0, len(text), size))
        assert marks == text
        part = grams.counts(text)
        # runs of other characters count once for each slice they lie in, letters always once
        assert abs(int(part[1].sum()) - int(whole[1].sum())) <= 3 * text.count(" ") * 2
    assert grams.counts("123 ... !") is None and grams.counts("") is None and grams.counts(None) is None


def test_scores_by_hand(spark, frame):
    docs = frame((1, "aaa aab", "x"), (2, "bbb bba", "y"), (3, "aba", None), (4, None, "x"))
    model = language.train(docs, bits=8)
    assert model.labels == ["x", "y"]
    got = {r.doc_id: r for r in language.predict(docs.select("doc_id", "text"), model).collect()}
    grams = language.Grams(8)
    for row in docs.collect():
        found = grams.counts(row.text)
        if found is None:
            assert (got[row.doc_id].lang_pred, got[row.doc_id].score) == ("und", 0.0)
            continue
        logs = model.log_prior + sum(n * model.log_prob[b] for b, n in zip(*found))
        p = np.exp(logs - logs.max())
        assert got[row.doc_id].lang_pred == model.labels[int(p.argmax())]
        assert got[row.doc_id].score == pytest.approx(p.max() / p.sum())


def test_bound_of_the_fit(frame):
    docs = frame(*((n, "abc" if n % 2 else "xyz", "a" if n % 2 else "b") for n in range(400)))
    model = language.train(docs, max_rows=100, bits=8)
    assert model.labels == ["a", "b"]


def test_rare_labels_are_taken_whole(frame):
    assert language._quota([1000, 10, 50], 100) == 45 and language._quota([3, 4], 7) == float("inf")
    docs = frame(*((n, "abc abd", "a") for n in range(3000)), *((5000 + n, f"qrs{n}", "rare") for n in range(3)))
    model = language.train(docs, max_rows=100, bits=8)
    assert model.labels == ["a", "rare"] and model.log_prior[1] == pytest.approx(np.log(3 / 3003))
    whole = language.train(docs, bits=8)
    assert np.array_equal(model.log_prob[:, 1], whole.log_prob[:, 1])  # all three of its rows
    assert not np.array_equal(model.log_prob[:, 0], whole.log_prob[:, 0])


def test_columns_named_as_the_answer_are_replaced(frame):
    docs = frame((1, "aaa", "x"), (2, "bbb", "y")).selectExpr("*", "1 AS score", "2 AS LANG_PRED")
    made = language.predict(docs, language.train(docs, bits=8))
    assert made.columns == ["doc_id", "text", "lang", "source", "n_chars", "lang_pred", "score"]
    assert {r.lang_pred for r in made.collect()} == {"x", "y"}


def test_odd_rows(odd, empty):
    model = language.train(odd.withColumn("lang", odd["source"]), bits=8)
    assert model.labels == []
    assert {r.score for r in language.predict(odd.select("doc_id", "text"), model).collect()} == {0.0}
    trained = language.train(odd.selectExpr("doc_id", "text", "'qq' AS lang"), bits=8)
    rows = language.predict(odd, trained, into=("found", "sure")).collect()
    assert len(rows) == odd.count() and rows[0]["_th"] is not Ellipsis
    for r in rows:
        letters = any(c.isalpha() for c in r.text or "")
        assert (r.found, r.sure) == (("qq", 1.0) if letters else ("und", 0.0))
    assert language.predict(empty, trained).count() == 0 and language.train(empty, bits=8).labels == []


def test_slices_do_not_show(monkeypatch):
    text = "Der Hund... 12 -- läuft!!  a,b  " * 40 + "...  "
    whole = language.Grams(12).counts(text)
    for length in (1, 2, 3, 7, 64, len(text) - 2, len(text)):
        monkeypatch.setattr(language, "SLICE", length)
        sliced = language.Grams(12).counts(text)
        assert [part.tolist() for part in sliced] == [part.tolist() for part in whole]
