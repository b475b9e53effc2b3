"""Times the headline queries on one data directory and prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from sparkwright import catalog
from sparkwright.session import get_session

HEADLINE = (
    "text_tokens_topk",
    "text_tfidf",
    "text_bm25",
    "text_cooccur",
    "text_ngrams",
    "stats_moments",
    "stats_quantile_linear",
    "stats_ranks",
    "stats_spearman",
    "stats_histogram",
    "seq_running",
    "seq_decompose",
    "surv_kaplan_meier",
    "test_mann_whitney",
    "info_entropy_mi",
    "metric_ranking_quality",
    "metric_ranked_lists",
    "metric_clusterings",
    "knn_euclidean",
    "graph_components",
    "tab_target_encode",
    "mine_subgroups",
    "mine_pairs",
    "rel_pricing_summary",
    "rel_join_range",
    "rel_cube",
    "stream_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = get_session("bench", os.environ.get("BENCH_CPUS", "8"))
    spark.sparkContext.setLogLevel("ERROR")
    plans = catalog.QUERIES
    # the first query also starts the executors' code; it is run once beforehand
    plans[HEADLINE[0]](spark, sf_dir).write.format("noop").mode("overwrite").save()
    seconds = {}
    for name in HEADLINE:
        began = time.perf_counter()
        plans[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - began, 3)
        spark.catalog.clearCache()
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
