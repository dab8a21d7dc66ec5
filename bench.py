"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

from pyspark.sql import SparkSession

from mnemospark.workload import catalog

HEADLINE = [
    "effective_frequency", "full_weight", "feedback_fold", "rrf_topk", "two_stage", "similar_memories", "separation",
    "supersession", "rule_conflicts", "gate_stateful", "traceback", "risk_score", "representative", "pitfall_merge",
    "near_dup_suppress", "ingest_dedup", "latency_percentile", "boosted_cosine_topk", "mixed_search", "relates_to", "keyword_embedding",
    "write_pipeline", "consolidation_run", "edit_context",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-checkpoint-"))  # one machine, so shared
        .config("spark.cleaner.referenceTracking.cleanCheckpoints", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start-up, class loading and the first Python worker are not a query's cost.
    catalog.QUERIES["feedback_delta"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    catalog.QUERIES["keyword_embedding"](spark, sf_dir.rsplit("sf", 1)[0] + "sf0.001").collect()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        catalog.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
