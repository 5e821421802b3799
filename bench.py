"""Benchmark: headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS].

Each query is executed in full with the ``noop`` sink (no collect), once to
warm up and then ``BENCH_REPEAT`` times; the per-query value is the median.
Prints one JSON line.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "localization_metrics", "metric_summary", "effort_at_recall", "recall_at_loc",
    "text_localization_metrics", "similar_line_replace", "multiset_overlap",
    "match_ground_truth", "clean_source", "word_frequency", "classification_report",
    "length_reduce", "stratified_split", "rouge_n", "token_budget_flags",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    names = sys.argv[1:] or HEADLINE
    from linesight.plans import load_all
    from linesight.session import build_session
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus),
                          driver_memory=os.environ.get("LINESIGHT_DRIVER_MEMORY", "16g"))
    queries, _ = load_all()
    times = {}
    for name in names:
        fn = queries[name]
        runs = []
        for i in range(repeat + 1):
            t0 = time.perf_counter()
            fn(spark, sf_dir).write.mode("overwrite").format("noop").save()
            dt = time.perf_counter() - t0
            if i > 0:
                runs.append(dt)
        times[name] = round(statistics.median(runs), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "sum_of_median_query_seconds", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf}))
    spark.stop()


if __name__ == "__main__":
    main()
