"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from spoor.plans import registry  # noqa: E402
from spoor.session import local_session  # noqa: E402

HEADLINE = [
    "event_summary", "burst_then_success", "publisher_whitelist", "file_scores", "file_stats",
    "top_files", "in_attack_window", "creation_clusters", "renamed_hashes", "benign_exclusion",
    "merge_connections", "graph_nodes", "report_summary", "trace_index", "replay", "cost_rollup",
    "pivot_search", "process_forest", "file_paths", "pack_chunks", "entity_lookup", "text_entropy",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = local_session(os.environ.get("BENCH_CPUS", "8"), "bench")
    # start-up of the JVM and of its text tables is not part of any query
    spark.sql("SELECT lower(concat('É', id)) FROM range(1000)").write.format("noop").mode(
        "overwrite"
    ).save()
    seconds = {}
    for name in HEADLINE:
        for _ in range(2):  # the second run counts, when its code is compiled
            start = time.perf_counter()
            registry.QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
