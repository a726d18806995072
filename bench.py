"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]: median of warm runs, one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from codequarry.session import build_session  # noqa: E402
from codequarry.registered import catalog  # noqa: E402

HEADLINES = [
    "vector_topk", "hybrid_search", "keyword_boost", "callees_bfs_depth3", "reachable_from_entries", "cycles_scc", "secret_scan", "line_metrics", "cyclomatic",
    "cognitive", "halstead", "route_normalize", "route_match_score", "snapshot_diff", "calls_first_wins", "pattern_share", "library_usage", "find_usages",
    "codeowners_last_match", "diff_impact", "chunk_texts", "parse_python_chunks", "parse_brace_chunks", "implementations_transitive", "golden_files", "affected_tests",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]", spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g",
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries = catalog.all_queries()
    chosen = sys.argv[1:] or HEADLINES
    seconds = {}
    for name in chosen:
        runs = []
        for _ in range(repeats + 1):
            start = time.perf_counter()
            queries[name][0](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(runs[1:]), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": sf_dir}))
    spark.stop()


if __name__ == "__main__":
    main()
