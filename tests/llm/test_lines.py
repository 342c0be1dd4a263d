import re
from hashlib import md5

import pytest

from gleanbase.llm import lines
from gleanbase.llm.queries import op8_line_dedup

SF = "/root/testdata/sf0.01"


def plain(docs, least):
    """Every run of lines with enough words against all earlier ones. ``docs``: (order, text), in order."""
    seen, out = {}, {}
    for order, text in docs:
        if text is None:
            out[order] = (None, 0, 0)
            continue
        split = text.split("\n")
        filled = [(n, re.findall(r"[^\x20\x09-\x0D]+", x)) for n, x in enumerate(split)]
        filled = [(n, w) for n, w in filled if w]
        lost = set()
        for a in range(len(filled)):
            total, run = 0, md5()
            for b in range(a, len(filled)):
                total += len(filled[b][1])
                run.update(" ".join(filled[b][1]).encode() + b"\n")
                if total >= least and seen.setdefault(run.digest(), (order, a)) != (order, a):
                    lost |= set(range(a, b + 1))
        gone = {filled[k][0] for k in lost}
        for k in range(len(filled) - 1):
            if k in lost and k + 1 in lost:
                gone |= set(range(filled[k][0], filled[k + 1][0]))
        kept = [x for n, x in enumerate(split) if n not in gone]
        if filled and len(lost) == len(filled):
            kept = []
        out[order] = ("\n".join(kept), len(split), len(split) - len(kept))
    return out


def test_query(spark):
    docs = sorted((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect())
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in op8_line_dedup(spark, SF).collect()}
    want = plain(docs, 50)
    assert got == want and sum(w[2] > 0 for w in want.values()) > 20


@pytest.mark.parametrize("least", [1, 3, 6])
def test_runs(frame, least):
    a, b, c, d = "a1 a2", "b1  b2 b3", "c1", "d1 d2 d3 d4"
    docs = [(1, f"{a}\n{b}\n\n{c}"), (2, f"x\n{b}\n\n \n{c}\ny"), (3, f"{c}\n{d}\n{c}\n{d}\n{c}\n{d}"), (4, f"{a}\n{b}\n{c}\n"),
            (5, None), (6, ""), (7, "\n\n"), (8, f"{d}\nz\n{a}\n b1 b2\tb3\n{c} "), (9, c), (10, f"{a}\n{b}"), (11, f"{b}\n{a}")]
    got = {r.doc_id: (r.text, r.n_lines, r.n_removed) for r in lines.dedup_lines(frame(*docs), min_words=least).collect()}
    assert got == plain(docs, least)


def test_hot_passage(spark, frame):
    passage = "\n".join(" ".join(f"p{n}w{k}" for k in range(20)) for n in range(4))
    docs = [(n, f"head {n} of its own\n{passage}\ntail {n}") for n in range(300)]
    rows = {r.doc_id: r for r in lines.dedup_lines(frame(*docs)).collect()}
    assert rows[0].text == docs[0][1]
    assert all(rows[n].text == f"head {n} of its own\ntail {n}" and rows[n].n_removed == 4 for n in range(1, 300))


def test_tail_of_a_run(frame):
    def line(name, n):
        return " ".join(f"{name}{k}" for k in range(n))

    passage = "\n".join((line("a", 9), line("b", 30), line("c", 25), line("d", 8), line("e", 3)))
    docs = [(n, f"{line(f'own{n}x', 45)}\n{passage}\n{line(f'end{n}x', 45)}") for n in range(3)]
    rows = {r.doc_id: r for r in lines.dedup_lines(frame(*docs)).collect()}
    assert rows[0].text == docs[0][1] and [rows[n].n_removed for n in (1, 2)] == [5, 5]
    assert rows[2].text == f"{line('own2x', 45)}\n{line('end2x', 45)}"


def test_odd_rows(odd, empty):
    rows = lines.dedup_lines(odd, min_words=2, into=("had", "lost")).collect()
    texts = odd.select("doc_id", "text").collect()
    assert sorted(map(repr, ((r.doc_id, r.text) for r in rows))) == sorted(map(repr, texts_as(texts)))
    assert {r["_th"] for r in rows if r.doc_id == 2} == {""} and {r.had for r in rows if r.text is None} == {0}
    assert lines.dedup_lines(empty).count() == 0


def texts_as(rows):
    return [(r.doc_id, r.text) for r in rows]  # rows that repeat id and text are one: nothing is lost
