"""Benchmark of the headline queries.

Runs each query on $BENCH_SF_DIR (default /root/testdata/sf0.1) on
local[$BENCH_CPUS], one warm-up then the median of $BENCH_REPEATS runs, and
prints one JSON line. A run executes the whole plan into Spark's ``noop``
sink, so nothing is pulled to the driver.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ["team_rankings", "activity_feed", "admin_orders", "inventory_state", "admit_orders"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "3"))
    names = sys.argv[1:] or HEADLINE

    from coffer.registry import QUERIES, run_admission
    from coffer.session import build_session

    spark = build_session(master=f"local[{cpus}]", shuffle_partitions=int(cpus))
    timings, extra = {}, {}
    for name in names:
        def once():
            t0 = time.perf_counter()
            if name == "admit_orders":
                _, adm = run_admission(spark, sf_dir)
                adm.results.write.format("noop").mode("overwrite").save()
                extra["admit_orders_rounds"] = adm.rounds
            else:
                QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            return time.perf_counter() - t0

        once()
        timings[name] = round(statistics.median(once() for _ in range(repeats)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "headline_query_seconds_total", "value": round(sum(timings.values()), 3),
                      "unit": "sec", "queries": timings, "sf": sf, "cpus": int(cpus), "repeats": repeats,
                      **extra}))
    spark.stop()


if __name__ == "__main__":
    main()
