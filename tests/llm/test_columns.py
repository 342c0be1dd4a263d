from pyspark.sql import functions as F

from gleanbase.llm import simhash, tokens


def test_columns_named_like_the_result_are_replaced(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, None), (2, None), (3, "")], "doc_id int, text string")
    taken = docs
    for name in ("fp", "Piece", "start", "length", "IDS", "n"):
        taken = taken.withColumn(name, F.lit("old"))

    def rows(df):
        return sorted((tuple(r) for r in df.collect()), key=repr)

    assert rows(simhash.fingerprints(taken).select("doc_id", "fp")) == rows(simhash.fingerprints(docs))
    assert rows(tokens.pieces(taken, tokens.byte_bpe()).select("doc_id", "piece", "start", "length", "ids")) == rows(
        tokens.pieces(docs, tokens.byte_bpe()))
    plain = tokens.count_tokens(docs, {"n": (tokens.byte_bpe(), None)})
    assert rows(tokens.count_tokens(taken, {"n": (tokens.byte_bpe(), None)}).select("doc_id", "n")) == rows(plain)
    # the column that says which rows are wanted may bear the name of the counts
    some = docs.withColumn("n", F.col("doc_id") == 1)
    assert [r.n for r in tokens.count_tokens(some, {"n": (tokens.byte_bpe(), "n")}).orderBy("doc_id").collect()][1:] == [None] * 3
