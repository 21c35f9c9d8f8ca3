"""Runs the headline queries at $BENCH_SF_DIR and prints one JSON line: the median of three warm runs of each."""

from __future__ import annotations

import json
import os
import time
from statistics import median

from casebook.plans.registry import QUERIES
from casebook.plans.session import session

HEADLINE = (
    "tl_page1", "tl_combined", "search_page", "corr_keys", "corr_pairs", "entity_table", "relationships", "entity_graph", "corr_chain",
    "seq_exfil", "seq_brute", "seq_bad_deploy", "replay_schedule", "parse_json", "bundle_root",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = session(
        "bench", **{"spark.master": f"local[{cpus}]", "spark.driver.memory": "8g", "spark.sql.shuffle.partitions": cpus, "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"}
    )
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in HEADLINE:
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        times[name] = round(median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
