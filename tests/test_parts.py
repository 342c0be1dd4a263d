import pyarrow as pa

from gleanbase.operators.spread import in_parts


def test_slices_hold_every_row_in_order():
    batches = [pa.record_batch({"n": list(range(at, at + size))}) for at, size in ((0, 7), (7, 0), (7, 3))]
    parts = list(in_parts(batches, 3))
    assert max(p.num_rows for p in parts) == 3
    assert [n for p in parts for n in p.column(0).to_pylist()] == list(range(10))


def test_an_encoder_gets_a_bounded_number_of_texts(spark):
    from pyspark.sql import functions as F

    from gleanbase.operators.embed import TEXTS, HashEncoder, embed

    def make():
        encode = HashEncoder()

        def checked(texts):
            assert len(texts) <= TEXTS
            return encode(texts)
        return checked

    df = spark.range(8000).select("id", F.col("id").cast("string").alias("crawled_text"))
    assert embed(df, make_encoder=make).filter(F.size("embedding") == 384).count() == 8000
