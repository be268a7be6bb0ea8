"""Headline queries on one machine: one JSON line with seconds per query.

BENCH_SF_DIR (default /root/testdata/sf0.1) and BENCH_CPUS (default 8) choose the data and the cores; a query is
run once to warm up on the same session and counted by the better of the next runs.
"""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from sentrel.catalog import QUERIES  # noqa: E402
from sentrel.session import local_session  # noqa: E402

HEADLINE = [
    "risk_report", "tag_sources", "tag_sinks_dedup", "sanitizer_block", "secret_entropy", "enclosing_block", "decorator_fallback", "compat_pairs",
    "enrich_left", "like_lookup_top", "keyword_search", "index_search", "semantic_topk", "best_per_sink", "tiered_budget", "keep_first",
    "shortest_paths", "call_edges_by_name", "lifetime_pairs", "path_fold", "confusion", "anomaly", "vote", "inventory", "tree_hash", "path_summary",
    "json_extract", "event_windows"]


def main() -> None:
    sf_dir, cores = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), int(os.environ.get("BENCH_CPUS", "8"))
    spark = local_session(cores, cores, os.environ.get("BENCH_MEMORY", "8g"))
    spark.sparkContext.setLogLevel("ERROR")
    seconds = {}
    for name in HEADLINE:
        runs = []
        for _ in range(2):
            t = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t)
        seconds[name] = round(min(runs), 3)
    print(json.dumps({"metric": "headline_seconds", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1], "cores": cores}))


if __name__ == "__main__":
    main()
