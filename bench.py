"""Headline queries with full materialisation; prints one JSON line.

BENCH_SF_DIR picks the tables, BENCH_CPUS the cores, BENCH_RUNS the timed runs per query (median is reported).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from millrace.plans.registry import queries
from millrace.session import local_session

HEADLINE = (
    "top_mean_location", "price_bins", "revenue_by_restaurant", "top_per_segment", "describe", "quantiles", "daily_return",
    "volatility_top10", "monthly_return", "gainers_losers", "correlation", "sequences", "tfidf", "similar_docs", "match_text",
    "html_text", "lemmatize", "report_rows", "knn_regress", "knn_embeddings", "silhouette", "dbscan", "kmeans",
    "forest_regress",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    partitions = int(cores) if cores.isdigit() else 8
    spark = local_session(cores, partitions)
    registered = queries()
    names = [n for n in sys.argv[1:] or HEADLINE if n in registered]

    def once(name: str) -> float:
        start = time.perf_counter()
        registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    timings = {}
    for name in names:
        once(name)
        timings[name] = round(statistics.median(once(name) for _ in range(runs)), 3)
        print(f"{name} {timings[name]}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
        "sf": os.path.basename(sf_dir.rstrip("/")),
    }))


if __name__ == "__main__":
    main()
