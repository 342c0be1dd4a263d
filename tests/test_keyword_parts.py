import re

from pyspark.sql import functions as F

from gleanbase.operators import keywords as K
from gleanbase.operators import skew


def test_tasks_of_the_word_counts_grow_with_the_texts(spark, monkeypatch):
    monkeypatch.setattr(K, "PART_ROWS", 10)
    made, plain = [], K.word_counts
    monkeypatch.setattr(K, "word_counts", lambda *a: made.append(plain(*a)) or made[-1])
    df = spark.range(200).select(F.col("id").cast("string"), F.concat(F.lit("a b"), F.col("id") % 3).alias("crawled_text"))
    assert K.keyword_index(df).count() == 400
    assert made[0].groupBy(F.spark_partition_id()).count().count() > 10  # not the session's four


def test_an_index_with_hot_words_is_not_shuffled_for_few_words(spark, tmp_path):
    """Words in most blocks made a join that moved the whole index, however few words were wanted."""
    n = skew.HOT_ROWS + 1
    spark.range(n).select(F.col("id").cast("string"), F.explode(F.array(F.lit("a"), F.concat(F.lit("w"), "id"))).alias("word"),
                          F.lit(0.5).alias("weight")).write.parquet(f"{tmp_path}/index")
    spark.createDataFrame([("a",), ("w7",), ("a",), (None,), ("x",)], "word string").write.parquet(f"{tmp_path}/wanted")
    index, wanted = (spark.read.parquet(f"{tmp_path}/{name}") for name in ("index", "wanted"))
    blocks = spark.range(n).select(F.col("id").cast("string"), F.lit("u").alias("source_url"))
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "256k")
    try:
        found = K.keyword_lookup(index, blocks, wanted)
        rows = {(r.word, r.id) for r in found.collect()}
        plan = found._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)
    assert rows == {("a", str(x)) for x in range(n)} | {("w7", "7")}
    assert "LeftSemi" in plan and not re.search(r"hashpartitioning\(word#\d+, _salt", plan)
