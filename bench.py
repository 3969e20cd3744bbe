"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from storyloom.plans.catalog import load

HEADLINE = [
    "feed_hot", "feed_all_filters", "feed_enriched", "story_detail", "search_lexical", "search_many", "search_hybrid",
    "postings", "knn_exact", "knn_ivf", "domain_fuzzy", "story_upsert", "article_upsert", "summary_upsert", "tag_upsert",
    "delete_cascade", "integrity_report", "run_funnel", "seen_dedupe", "metrics_daily", "extract_html", "language_id",
    "result_to_vocab", "candidate_tags", "stages_end_to_end",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("storyloom-bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.ui.enabled", "false")
        .config("spark.driver.memory", "12g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load()
    spark.read.parquet(f"{folder}/documents.parquet").groupBy("lang").count().collect()
    took = {}
    for key in HEADLINE:
        start = time.perf_counter()
        queries[key](spark, folder).write.format("noop").mode("overwrite").save()
        took[key] = round(time.perf_counter() - start, 3)
    spark.stop()
    name = os.path.basename(folder.rstrip("/"))
    print(json.dumps({"metric": "headline_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": name}))


if __name__ == "__main__":
    main()
