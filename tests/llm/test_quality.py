import random
import re

import pytest
import zstandard
from hypothesis import given, settings
from hypothesis import strategies as st

from gleanbase.llm import quality
from gleanbase.llm.queries import op2_compression_bands

SF = "/root/testdata/sf0.001"


def plain(text):
    """The counts, straight from their definitions."""
    words = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    inside = {p + j for p, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)} if len(words) < 3000 else None
    lines = [x for x in (text or "").split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)),
            len(inside) if inside is not None else None)


def test_query(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    rows = op2_compression_bands(spark, SF).collect()
    assert len(rows) == len(docs)
    for r in rows:
        *want, repeats = plain(docs[r.doc_id])
        assert [r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines] == want
        assert repeats in (None, r.n_repeat_words)
        assert r.base_failed == (r.n_words < 20 or 100 * r.n_repeat_words > 30 * r.n_words)
        assert not (r.base_failed and r.kept)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.sampled_from(["a", "b", "c"]), max_size=60))
def test_repeated_words(words):
    windows = [tuple(words[k:k + 8]) for k in range(len(words) - 7)]
    want = {p + j for p, w in enumerate(windows) if windows.count(w) > 1 for j in range(8)}
    assert quality.repeated_words([w.encode() for w in words]) == len(want)


def test_bands():
    press = zstandard.ZstdCompressor(level=3)
    rng = random.Random(5)
    syllables = "an er in on th st re he nd ou ea ti ed at en es".split()
    prose = " ".join("".join(rng.choices(syllables, k=rng.randint(1, 4))) for _ in range(3000))
    noise = " ".join("".join(chr(rng.randint(0x21, 0x10FFF)) for _ in range(8)) for _ in range(500))
    for cut in (150, 400, 900, 3000, 9000, len(prose)):
        assert quality.measure(prose[:cut], press)[6], cut
    assert not quality.measure(noise, press)[6]
    # no window of eight words repeats, but little else changes
    same = " ".join(f"value number {n} is here" for n in range(4000))
    row = quality.measure(same, press)
    assert not row[5] and not row[6] and row[7] < 0.17
    half_noise = prose[:9000] + noise + noise
    assert quality.measure(half_noise, press)[8] > 0.5 and not quality.measure(half_noise, press)[6]
    assert quality.ratios(b"", press) == (1.0, 0.0)


@pytest.mark.parametrize("alphabet,least", [("0123456789", 16_384), ("0123456789abcdef", 4096), ("abcdefghijklmnopqrstuvwxyz", 2048), (
    "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", 512)])
def test_noise_is_rejected_from_the_length_on_that_tells_it(alphabet, least):
    press, rng = zstandard.ZstdCompressor(level=3), random.Random(2)
    for size in (300, 512, 1500, 2048, 4096, 6000, 16_384, 30_000, 100_000):
        for _ in range(5):
            text = " ".join("".join(rng.choices(alphabet, k=rng.randint(3, 10))) for _ in range(size // 4))[:size]
            if size >= least:
                assert not quality.measure(text, press)[6], size


def test_few_words_over_and_over_are_rejected():
    press, rng = zstandard.ZstdCompressor(level=3), random.Random(3)
    for size in (2048, 6000, 30_000):
        text = " ".join(rng.choices(["buy", "now", "cheap"], k=size // 5))[:size]
        row = quality.measure(text, press)
        assert not row[6] and row[7] < 0.3


def test_prose_is_kept(spark):
    rows = quality.judge(spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")).filter("NOT base_failed").collect()
    assert len(rows) > 9000 and sum(r.kept for r in rows) > 0.99 * len(rows)


def test_odd_rows(odd, empty):
    rows = {(r.doc_id, r.text): r for r in quality.judge(odd).collect()}
    assert rows[1, None].n_words == rows[2, ""].n_words == rows[3, " \n\t\n "].n_words == 0
    assert all(rows[k].base_failed and not rows[k].kept for k in ((1, None), (2, ""), (None, None)))
    assert rows[8, "a b c\u0085d e"].n_words == 2  # only the six ASCII separators part words
    long = next(r for r in rows.values() if r.doc_id == 4)
    assert long.n_words == long.n_repeat_words == 160_000 and long.base_failed
    assert rows[5, "one two three"]["salt"] == 1 and "kept" in rows[5, "one two three"].asDict()
    assert quality.judge(empty).count() == 0
