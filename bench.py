"""Times the headline queries and prints one JSON line.

BENCH_SF_DIR: data folder (default /root/testdata/sf0.1); BENCH_CPUS: local cores (default 8).
"""

from __future__ import annotations

import json
import os
import sys
import time

from barloom.session import local_session

HEADLINES = [
    "agg10_daily_bar_rollup", "fea01_scanner_features", "win02_relative_returns", "ind_series_recursive", "ind_latest_recursive",
    "sco01_composite_signal", "sco05_fundamental_score", "agg06_results_history", "win15_price_reaction", "agg02_sector_rollup",
    "win16_rank", "evt01_classify", "evt01_classify_documents", "evt09_jon10_novelty", "agg07_event_summary",
    "dup06_07_story_clusters", "pip02_result_screen", "pip01_pre_result_scan", "str03_five_minute_bars", "str02_one_shot_alerts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = local_session(cores=cpus, shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    from barloom.registry import QUERIES

    only = sys.argv[1:]
    seconds = {}
    QUERIES["agg10_daily_bar_rollup"](spark, sf_dir).limit(1).collect()          # start-up is not a query
    for name in only or HEADLINES:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
                      "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
