"""Headline queries on one machine: prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from evidence_spark.plans import load_all
from evidence_spark.session import get_spark

HEADLINE = ["rate_table", "describe_words", "token_counts", "bigram_top", "vocabulary_stats", "page_articles", "title_jaccard_pairs", "cosine_pairs",
            "contamination", "near_in_time", "slice_metrics", "pr_curve", "cluster_bootstrap_diff", "stratified_split", "quantities", "entity_mentions",
            "claim_evidence", "synthesis", "tfidf_top_terms", "linear_scores", "score_pairs", "event_verdict", "republication_clusters", "drift_watch_daily"]


def main() -> None:
    root = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = get_spark("bench", f"local[{cpus}]", **{"spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    registry = load_all()
    registry["null_profile"].run(spark, root).collect()  # start the engine before the clock
    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        registry[name].run(spark, root).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds,
                      "sf": os.path.basename(root.rstrip("/"))}))


if __name__ == "__main__":
    main()
