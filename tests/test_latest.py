import random

from helpers import tuples
from pyspark.sql import functions as F

from gleanbase.streaming.latest import newer_only

SCHEMA = "id string, at long, seq long, name string, x double, n int, t timestamp, z timestamp_ntz, many array<string>"


def land(spark, folder, rows):
    df = spark.createDataFrame([(r[0], r[1], r[2], r[3]) for r in rows], "id string, at long, seq long, name string")
    df.selectExpr("*", "0.1 * seq AS x", "CAST(if(seq % 2 = 0, seq, null) AS int) AS n", "timestamp_micros(at + 123456) AS t",
                  "CAST(timestamp_micros(at + 123457) AS timestamp_ntz) AS z", "array(name, null, '') AS many").select(
        "id", "at", "seq", "name", F.col("x").cast("double"), "n", "t", "z", "many").coalesce(1).write.mode("append").parquet(folder)


def run(spark, folder, checkpoint, out):
    rows = newer_only(spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(folder), "id", ["at", "seq"])

    def take(batch, number):
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    rows.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()


def test_late_and_repeated_rows_across_restarts(spark, tmp_path):
    folder, checkpoint, out = (str(tmp_path / n) for n in ("landing", "checkpoint", "out"))
    rng = random.Random(3)
    rows = [(f"k{rng.randrange(30)}", rng.randrange(50), n, f"name {n}") for n in range(600)]
    rows += [("hot", 7, 600 + n, f"hot {n}") for n in range(300)]
    rng.shuffle(rows)
    files = [rows[:300], rows[300:600], rows[600:]]
    odd = [(None, 99, 9999, "no key"), ("k1", None, 9999, "no time"), ("k2", 10 ** 15, None, "no number")]
    for part in [files[0], files[1] + odd, files[2], files[0], rows[::-1]]:  # the last two are replays
        land(spark, folder, part)
        run(spark, folder, checkpoint, out)
    made = spark.read.parquet(out)
    last = {}
    for r in rows:
        last[r[0]] = max(last.get(r[0], r), r, key=lambda r: (r[1], r[2]))
    final = made.groupBy("id").agg(F.max_by(F.struct(*made.columns), F.struct("at", "seq")).alias("r")).select("r.*")
    assert tuples(final, "id", "at", "seq", "name") == sorted(last.values(), key=repr)
    # each row that comes out is newer than all before it, so replays and late rows give none
    steps = {}
    for r in sorted(made.collect(), key=lambda r: r.batch):
        assert (r.at, r.seq) > steps.get(r.id, (-1, -1))
        steps[r.id] = (r.at, r.seq)
    assert made.count() < 31 * 4 and made.filter("batch > 2").count() == 0
    # nothing was changed on the way
    whole = made.selectExpr("*", "0.1 * seq AS ex", "CAST(if(seq % 2 = 0, seq, null) AS int) AS en", "timestamp_micros(at + 123456) AS et",
                            "CAST(timestamp_micros(at + 123457) AS timestamp_ntz) AS ez", "array(name, null, '') AS em")
    assert whole.filter("NOT (x <=> CAST(ex AS double) AND n <=> en AND t <=> et AND z <=> ez AND many <=> em)").count() == 0
