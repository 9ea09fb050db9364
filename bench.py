"""Time the headline queries on one local session and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tallymill.plans.queries import all_queries
from tallymill.session import configure

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
HEADLINE = [
    "monthly_debits", "filter_drop_reasons", "rule_hits", "parse_summary", "category_breakdown", "dedup_priority",
    "duplicate_flags", "transfer_candidates", "transfer_pairs_exact", "account_dim", "balance_latest",
    "ingest_summary", "feed_page", "needs_review", "edit_overlay", "split_apply", "body_filter_documents",
    "taxonomy_best", "stream_parse",
]


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    configure(spark)
    queries = all_queries()
    spark.range(1).count()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        queries[name](spark, SF_DIR).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
