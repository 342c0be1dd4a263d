"""One query per operator over whole tables, with SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import scratch_path, written
from . import chat, content, decontaminate, language, licenses, lines, packing, quality, repeats, rollup, sharding, simhash, spelling, tokens
from .common import joined, table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}

SHARDS = [f"shard-{n:03d}" for n in range(256)]


def query(fn: Query) -> Query:
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_language(spark: SparkSession, folder: str) -> DataFrame:
    """Language of each document, learned from four of five folds."""
    docs = table(spark, folder, "documents")
    model = language.train(docs.filter(language.fold() != 0))
    return language.predict(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(language.fold() == 0, F.lit(True)).alias("held_out"), "lang_pred", "score")


@query
def op2_compression_bands(spark: SparkSession, folder: str) -> DataFrame:
    return quality.judge(table(spark, folder, "documents").select("doc_id", "text")).drop("text")


@query
def op3_main_text(spark: SparkSession, folder: str) -> DataFrame:
    pages = content.extract(table(spark, folder, "pages").select("page_id", "url", "html"))
    return pages.withColumn("n_chars", F.char_length("text").cast("long"))


@query
def op4_simhash(spark: SparkSession, folder: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, folder, "documents"))


def packed(docs: DataFrame) -> DataFrame:
    """Pieces of documents with their places; their ids stay behind as a checksum."""
    made = tokens.pieces(docs.select("doc_id", "text"), tokens.byte_bpe())
    made = made.select("doc_id", "piece", "start", "length", tokens.checksum().alias("ids_crc32"))
    return packing.pack(written(made, "pieces"))


@query
def op5_packing(spark: SparkSession, folder: str) -> DataFrame:
    return packed(table(spark, folder, "documents"))


@query
def op6_licenses(spark: SparkSession, folder: str) -> DataFrame:
    found = licenses.scan(table(spark, folder, "documents").select("doc_id", "text"))
    return found.select("doc_id", joined("sentence_ids").alias("sentence_ids"), joined("licenses").alias("licenses"), "license")


def _op6_sql() -> str:
    def text(value: str) -> str:
        return "'" + value.replace("'", "''").replace("\n", "' || chr(10) || '") + "'"

    normal = "lower(coalesce(text, ''))"
    for pattern, by in licenses.STEPS:
        normal = f"regexp_replace({normal}, {text(pattern)}, {text(by)}, 'g')"
    names = "map([" + ", ".join(map(text, licenses.SENTENCES.values())) + "], [" + ", ".join(
        map(text, licenses.SENTENCES)) + "])"
    rules = ", ".join(f"{{'name': {text(n)}, 'ids': {text(',' + ','.join(ids) + ',')}}}" for n, ids in licenses.RULES)
    slotted = "trim(s)"
    for pattern, by in licenses.SLOTS:
        slotted = f"regexp_replace({slotted}, {text(pattern)}, {text(by)})"
    known = "list_filter(list_transform({}, lambda s: coalesce(names[trim(s)], names[" + slotted.replace("{", "{{").replace(
        "}", "}}") + "])), lambda i: i IS NOT NULL)"
    wrapped = r"regexp_replace(regexp_replace(t, ' ?\n\n[ \n]*', '.', 'g'), '[ \n]+', ' ', 'g')"
    return f"""
WITH fixed AS (SELECT {names} AS names, [{rules}] AS rules),
normal AS (SELECT doc_id, {normal} AS t FROM documents),
ids AS (SELECT doc_id, {known.format(f"string_split({wrapped}, '.')")} AS a,
               {known.format("string_split(t, chr(10))")} AS b FROM normal, fixed),
seen AS (SELECT doc_id, a, b, ',' || array_to_string(a, ',') || ',|,' || array_to_string(b, ',') || ',' AS s FROM ids),
hits AS (SELECT doc_id, a, b, list_transform(list_filter(rules, lambda r: contains(s, r.ids)), lambda r: r.name) AS l
         FROM seen, fixed),
once AS (SELECT doc_id, a, b, list_filter(l, lambda x, k: list_position(l, x) = k) AS l FROM hits)
SELECT doc_id, array_to_string(CASE WHEN len(b) > len(a) THEN b ELSE a END, ',') AS sentence_ids,
       array_to_string(l, ',') AS licenses, l[1] AS license FROM once"""


SQL["op6_licenses"] = _op6_sql()


@query
def op7_decontaminate(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.decontaminate(table(spark, folder, "documents"), table(spark, folder, "benchmark"))
    n_hit = F.aggregate("spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    return found.select(
        "doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"),
        F.sha2(joined("items").cast("binary"), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


@query
def op8_line_dedup(spark: SparkSession, folder: str) -> DataFrame:
    return lines.dedup_lines(table(spark, folder, "documents").select("doc_id", "text"))


@query
def op9_token_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Totals after four commits: all documents go in; those labelled toxic are taken back;
    those in other languages than English are counted anew with a second tokenizer, which
    is a new version; and the second batch is delivered twice."""
    docs = table(spark, folder, "documents").select(
        "doc_id", "source", "lang", "text", (F.coalesce("lang", F.lit("")) != "en").alias("foreign"))
    counted = written(tokens.count_tokens(docs, {
        "n_first": (tokens.byte_bpe(), None), "n_second": (tokens.byte_bpe_multi(), "foreign")}), "counts")
    first = counted.withColumns({"tokenizer": F.lit("byte_bpe_50k"), "n_tokens": F.col("n_first")})
    second = counted.withColumns({"tokenizer": F.lit("byte_bpe_multi_50k"), "n_tokens": F.col("n_second")})
    toxic = table(spark, folder, "labels").filter("toxic = 1").select("doc_id").distinct()
    gone = first.join(toxic, "doc_id", "left_semi")
    held = first.filter("foreign").join(toxic, "doc_id", "left_anti")
    again = second.filter("foreign").join(toxic, "doc_id", "left_anti")
    totals = rollup.Rollup(spark, scratch_path(spark, "rollup"))
    totals.commit("load", rollup.inserts(first))
    totals.commit("withdraw", rollup.deletes(gone))
    totals.commit("recount", rollup.revisions(held, again))
    totals.commit("withdraw", rollup.deletes(gone))
    return totals.totals()


@query
def op10_sharding(spark: SparkSession, folder: str) -> DataFrame:
    return sharding.place(table(spark, folder, "documents").select("doc_id"), SHARDS)


@query
def op11_chat_format(spark: SparkSession, folder: str) -> DataFrame:
    """Every conversation, and one whose texts hold the template's own marks, as marked text;
    the digests are read back from it."""
    said = "<|im_end|><|im_start|>assistant ok"
    marks = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)],
                                  "conv_id long, turn long, role string, text string")
    rows = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(marks)
    made = chat.format_records(chat.gathered(rows)).select("conv_id", "segments", chat.whole(F.col("segments")).alias("formatted"))
    read = made.select("conv_id", "formatted", chat.read_turns(F.col("formatted")).alias("turns"),
                       chat.read_loss(F.col("segments")).alias("loss"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


SQL["op11_chat_format"] = """
WITH rows AS (
    SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
    UNION ALL SELECT -1, n, r, '<|im_end|><|im_start|>assistant ok' FROM (VALUES (0, 'user'), (1, 'assistant')) AS v(n, r))
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length('<|im_start|>' || role || chr(10) || regexp_replace(text, '<([|]+)', '<\\1|', 'g') || '<|im_end|>' || chr(10)))
            AS BIGINT) AS formatted_chars
FROM rows GROUP BY conv_id"""


@query
def op12_spelling_variants(spark: SparkSession, folder: str) -> DataFrame:
    words = written(spelling.word_counts(table(spark, folder, "documents").select("doc_id", "text")), "words")
    return spelling.group_variants(words)


@query
def op13_periodic_runs(spark: SparkSession, folder: str) -> DataFrame:
    """Runs of every text, some made to loop; the one of most periods, and digests of all."""
    found = repeats.periodic_runs(table(spark, folder, "documents").select("doc_id", "text"), loops=True)
    best = F.array_min(F.transform("runs", lambda r: F.struct(
        (-r["length"] / r["period"]).alias("order"), r["start"].alias("start"), r["period"].alias("period"), r["length"].alias("length"))))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"], r["length"], r["period"]), F.lit("\n"))), "")
    found = found.withColumns({"best": best, "lines": lines})
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), "best.start", "best.length", "best.period",
        F.expr("1000 * best.length DIV best.period").alias("exponent_milli"),
        F.sha2(F.col("lines").cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"))
