"""Headline-query bench: runs the main operators at $BENCH_SF_DIR on
local[$BENCH_CPUS] and prints ONE JSON line.

Each query is fully executed into Spark's ``noop`` sink (no driver collect):
once untimed (plan shapes, codegen, Python workers, file fixtures written),
then $BENCH_RUNS times (default 3); the median is reported."""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    # name in the registry -> what it exercises
    "feedback_timeline",       # D2 over events
    "score_clusters",          # A25 over events (F-clustered)
    "analyze_feedback",        # A27 end to end (F-feedback-vec, DBSCAN)
    "dbscan_cosine",           # C3 over embeddings
    "cosine_eps_join",         # C1 over embeddings
    "standardize_feedback",    # P8 over F-messy
    "read_csv_feedback",       # S1 round trip
    "text_lines_feedback",     # S3 over documents
    "page_line_feedback",      # S5 over documents
    "detect_severity",         # E1 over events
    "embed_terms",             # E3 in sparse form over documents
    "score_sentiment_bayes",   # E2 in closed form over documents
]


def main() -> None:
    from murmur.session import build_session
    from murmur.plans.registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session(cpus, shuffle_partitions=int(cpus) * 2 if cpus.isdigit() else 16, app="murmur-bench")
    names = sys.argv[1:] or HEADLINE
    # warm-up: JVM, codegen caches and the Python workers used by pandas functions
    QUERIES["detect_severity"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    spark.range(0, 64, 1, 8).groupBy("id").applyInPandas(
        lambda pdf: pdf, "id long").write.format("noop").mode("overwrite").save()
    runs = int(os.environ.get("BENCH_RUNS", "3"))

    def once(name):
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t0

    times = {}
    for name in names:
        once(name)
        times[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "total_headline_sec", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf, "runs": runs}))


if __name__ == "__main__":
    main()
