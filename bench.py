"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query runs twice and the second run counts (its result is written to the noop sink, so every row is made).
"""

from __future__ import annotations

import json
import os
import re
import time

from pyspark.sql import SparkSession

from quarryspark import queries

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = int(os.environ.get("BENCH_CPUS", "8"))
HEADLINE = ("knn_top5", "knn_filtered", "knn_union_dedup", "text_chunks", "page_chunks", "time_chunks", "heading_carry", "bm25_topk", "fact_containment", "conversation_detail", "history_oldest", "sources_catalog", "folder_counts", "tokens_sse", "latency_percentiles", "token_hash")


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]").appName("bench")
        .config("spark.sql.shuffle.partitions", str(CPUS))
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took, rows = {}, {}
    for name in HEADLINE:
        for _ in range(2):
            began = time.perf_counter()
            queries.QUERIES[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - began, 4)
    rows["text_chunks"] = queries.QUERIES["text_chunks"](spark, SF_DIR).count()
    n = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").count()
    q = spark.read.parquet(f"{SF_DIR}/embeddings.parquet").where("vec_id % 100 = 0").count()
    sf = re.search(r"sf([0-9.]+)", SF_DIR)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf[1]) if sf else SF_DIR,
        "throughput": {"chunks_per_s": round(rows["text_chunks"] / took["text_chunks"], 1), "query_vectors_per_s": round(n * q / took["knn_top5"], 1)},
    }))
    spark.stop()


if __name__ == "__main__":
    main()
