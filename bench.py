"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

os.environ.setdefault("PYTHONWARNINGS", "ignore")

from corpusquery.session import build_session
from workload.queries import REGISTRY

HEADLINE = [
    "search_term_ci", "search_term_cs", "search_regex", "search_and", "search_not_group",
    "filter_flags", "filter_symbol", "mode_lines", "mode_lines_capped", "mode_files",
    "mode_repos", "search_envelope", "line_matches", "fragments", "context", "gap_rows",
    "chunks", "highlight", "snippet", "top_files_by_score", "total_cap", "per_repo_cap",
    "duplicates", "search_stats", "search_cost", "repo_stats", "select_repos", "expand_rules",
    "ngram_postings", "candidates", "search_batch", "search_batch_anchored", "search_narrowed",
    "index_diff", "orphan_shards", "symbol_definitions", "latest_status", "evict_finished",
    "stream_latest_status", "stream_search",
    "search_batch_sentences", "search_regex_alternatives", "search_indexed", "top_files_bm25",
    "index_diff_rolled", "filter_symbol_stored", "stream_eviction",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = build_session(
        "bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": cpus,
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    # Start the JVM and its compiler before the first measurement.
    REGISTRY["search_or"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in names:
        start = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_time",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
