"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from gleanbase.plans.queries import QUERIES  # noqa: E402
from gleanbase.session import build_session  # noqa: E402

HEADLINE = [
    "search_topk", "search_cells", "search_text", "search_approx", "knn_graph", "expand_hops", "expand_nodes", "enrich_hits",
    "embed_hash", "html_markdown", "clean_markdown", "chunk_text", "keyword_index", "keyword_lookup",
    "flatten_channels", "complete_pages", "last_per_id", "block_rows", "upsert_keep_text",
    "upsert_table", "stream_ingest", "rag_prompt", "search_lsh", "knn_descent", "search_words",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    spark = build_session("bench", f"local[{cpus}]", **{
        "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false",
        "spark.driver.memory": "12g",
        "spark.checkpoint.dir": tempfile.mkdtemp(prefix="bench-"),
        "spark.sql.shuffle.partitions": cpus,
        # the test tables are single small files: let every core read a share
        "spark.sql.files.maxPartitionBytes": str(4 << 20),
    })
    spark.sparkContext.setLogLevel("ERROR")
    # start the JVM's and the Python workers' machinery once, outside the timings
    spark.range(1 << 20).repartition(int(cpus)).mapInArrow(lambda batches: batches, "id long").count()
    seconds = {}
    for name in HEADLINE:
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()  # code is compiled, files are read
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total seconds of the headline queries", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
