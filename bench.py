"""Wall seconds of the headline queries in a warm session, median of BENCH_REPEAT runs; prints one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from newsloom.plans import registry  # noqa: E402
from newsloom.session import get_session  # noqa: E402

HEADLINE = [
    "relevance_page", "personal_feed", "diversify_windows", "url_normalize", "dedup_url", "dedup_hash", "fuzzy_title_pairs", "dedup_3layer",
    "tfidf_weights", "story_pairs", "story_clusters", "burst_score", "headline_score", "publisher_rolling_24h", "triage_tier1",
    "triage_tier1_live", "budget_select", "event_pairs", "related_event_counts", "vector_topk", "event_resolve", "event_merge",
    "entity_extract", "digest_articles", "digest_top_events", "digest_fallback_articles", "recommended_articles", "page_text",
    "page_blocks", "page_clean", "token_f1", "sentence_rank", "stage_status", "usage_cost", "asof_rescore", "st_publisher_counts",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "1"))
    names = os.environ.get("BENCH_QUERIES", "").split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    registry.load_all()
    spark = get_session("bench", f"local[{cpus}]", **{
        "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false", "spark.driver.memory": "16g"})
    spark.sparkContext.setLogLevel("ERROR")
    for warm in ("stage_status", "page_blocks"):  # JVM, parquet reader and Python workers; not timed
        registry.QUERIES[warm](spark, folder).write.format("noop").mode("overwrite").save()
    took: dict[str, float] = {}
    for n in names:
        runs = []
        for _ in range(repeat):
            t0 = time.perf_counter()
            registry.QUERIES[n](spark, folder).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        took[n] = round(statistics.median(runs), 3)
        print(f"{n} {took[n]}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took,
                      "sf": folder.rstrip("/").split("sf")[-1], "cpus": int(cpus), "spark": spark.version}))


if __name__ == "__main__":
    main()
