"""Each stage of the pipeline beside a plain version of it, on small tables."""

import re
from collections import defaultdict

import pytest

import corpus_pipeline as pipeline
from gleanbase.llm import language

SF = "/root/testdata/sf0.001"


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.fixture(scope="module")
def benchmark(spark, tmp_path_factory):
    folder = str(tmp_path_factory.mktemp("bench"))
    spark.createDataFrame([(1, " ".join(f"item{n}" for n in range(12))), (2, "short item text"), (3, None), (4, "")],
                          "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder


def test_language_stage(spark, sample):
    kept = pipeline.identify_language(spark, sample, SF)
    assert kept.columns == sample.columns
    model = language.train(sample.filter(language.fold() != 0))
    named = language.predict(sample, model).collect()
    assert rows(kept) == sorted((tuple(r)[:5] for r in named if r.lang_pred != "und" and r.score >= 0.5), key=repr)
    assert not [r for r in kept.collect() if not any(c.isalpha() for c in r.text or "")]


def test_language_stage_without_labels(spark, odd, empty):
    kept = pipeline.identify_language(spark, odd, SF)
    assert kept.columns == odd.columns
    assert rows(kept.select("doc_id", "text")) == sorted(
        ((r.doc_id, r.text) for r in odd.collect() if any(c.isalpha() for c in r.text or "")), key=repr)
    assert pipeline.identify_language(spark, empty, SF).count() == 0


def test_line_stage(spark, frame, odd, empty):
    passage = "\n".join(f"line {n} of a passage with some more words to it" for n in range(8))
    docs = frame((1, f"first\n{passage}\nend"), (2, passage), (3, f"other\n{passage}"), (4, "alone"), (5, None), (6, ""))
    assert rows(pipeline.dedup_lines(spark, docs, SF).select("doc_id", "text")) == [
        (1, f"first\n{passage}\nend"), (3, "other"), (4, "alone"), (5, None), (6, "")]
    assert pipeline.dedup_lines(spark, odd, SF).columns == odd.columns
    assert pipeline.dedup_lines(spark, empty, SF).count() == 0


def test_near_duplicate_stage_on_odd_rows(spark, odd, empty):
    kept = pipeline.drop_near_duplicates(spark, odd, SF)
    assert kept.columns == odd.columns
    left = rows(kept.select("doc_id", "text"))
    # null, empty and blank texts, and those without words, share fingerprint zero
    assert [d for d, _ in left if d is not None] == [1, 4, 5, 5, 6, 7, 8] and sum(d is None for d, _ in left) == 2
    assert pipeline.drop_near_duplicates(spark, empty, SF).count() == 0


def test_contamination_stage(spark, frame, odd, empty, benchmark):
    item = " ".join(f"item{n}" for n in range(12))
    docs = frame((1, f"some words, {item.upper()} and more"), (1, "a clean text under the same id"), (None, item), (None, "clean"),
                 (2, "a SHORT item -- text"), (3, " ".join(item.split()[:9])), (4, None), (5, ""), (5, ""))
    windows = [tuple(item.split()[k:k + 10]) for k in range(3)] + [("short", "item", "text")]

    def hit(text):
        own = words(text)
        return any(tuple(own[k:k + len(w)]) == w for w in windows for k in range(len(own)))

    kept = pipeline.drop_contaminated(spark, docs, benchmark)
    assert rows(kept) == sorted((tuple(r) for r in docs.collect() if not hit(r.text)), key=repr)
    assert kept.count() == 6 and kept.columns == docs.columns
    assert rows(pipeline.drop_contaminated(spark, odd, benchmark)) == rows(odd)
    assert pipeline.drop_contaminated(spark, empty, benchmark).count() == 0


def test_packing_stage(spark, odd, empty):
    places = defaultdict(list)
    for r in pipeline.pack_sequences(spark, odd.filter("doc_id IS NOT NULL"), SF).collect():
        places[r.sequence_id].append((r.offset, r.length))
    for own in places.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= 2048
    assert pipeline.pack_sequences(spark, empty, SF).count() == 0


def test_run(spark, sample):
    """All stages in a row keep what each keeps alone."""
    docs = sample
    for _, stage in pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).collect(), sample.schema)
    packed = pipeline.run(spark, SF).select("doc_id", "piece", "start", "length", "ids_crc32")
    assert rows(packed) == rows(pipeline.pack_sequences(spark, docs, SF).select(*packed.columns))
    assert {r[0] for r in rows(packed)} == {r.doc_id for r in docs.collect()}
