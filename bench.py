"""Time the headline jobs and print one JSON line.

    BENCH_SF_DIR  table directory (default /root/testdata/sf0.1)
    BENCH_CPUS    cores of the local session (default 8)

The stored memory table is written first ("store_build"), as it would exist in
production; the jobs over stored memories then read it.
"""

from __future__ import annotations

import json
import os
import time

from memlake.plans.catalog import QUERIES
from memlake.plans import inputs
from memlake.session import local_session

HEADLINE = [
    "p22_extract_candidates", "p22_extract_memories", "w02_top_memories_per_session", "p23_infer_session_state",
    "d03_near_dup_pairs", "d03_near_dup_documents", "d04_merge_memories", "d08_dedup_candidates",
    "l07_detect_conflicts", "l07_conflict_counts", "l08_lifecycle_sweep", "t02_rebalance_counts",
    "r01_vector_topk", "r02_keyword_topk", "r04_fulltext_rank", "r15_hybrid_retrieve", "r18_working_set",
    "c03_group_candidates", "c07_consolidate", "c09_consolidation_sweep",
    "g04_graph_edges", "g07_extract_relationships", "g09_similar_by_keywords", "g12_keyword_cooccurrence",
    "g14_similar_memories", "g17_graph_context",
    "m03_job_counters", "m04_latency_histogram", "m06_event_rate", "m09_job_outcomes", "x08_stream_metrics",
]


def run(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session("bench")
    spark.sparkContext.setLogLevel("ERROR")
    seconds: dict[str, float] = {}

    def timed(name, job) -> None:
        start = time.perf_counter()
        job()
        seconds[name] = round(time.perf_counter() - start, 3)

    events = inputs.chat_events(spark, sf_dir).count()  # also warms the session up
    timed("store_build", lambda: inputs.stored(spark, sf_dir))
    only = os.environ.get("BENCH_ONLY", "").split(",") if os.environ.get("BENCH_ONLY") else HEADLINE
    for name in only:
        timed(name, lambda: run(QUERIES[name](spark, sf_dir)))
    total = round(sum(seconds.values()), 3)
    extract = seconds.get("p22_extract_memories")
    print(json.dumps({
        "metric": "headline_total", "value": total, "unit": "sec", "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "events": events, "events_per_sec": round(events / extract, 1) if extract else None}))
    spark.stop()


if __name__ == "__main__":
    main()
