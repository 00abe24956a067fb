"""Time the headline queries; prints one JSON line.

`BENCH_SF_DIR` (default sf0.1) names the data, `BENCH_CPUS` the cores, `BENCH_QUERIES` optionally
the queries. The warehouse tables are derived once, written partitioned by date, and read by the
queries, so that the times hold no derivation. Every row of a result is computed; nothing is collected.
Each query runs twice and the faster run counts; model training runs once.
"""

from __future__ import annotations

import json
import os
import sys
import time

from catalog import QUERIES
from doorclock import fixtures
from doorclock.session import local_session

HEADLINE = [
    "c_geofence_pings",
    "c_dwell",
    "courier_peak",
    "courier_peak_median",
    "poi_statistics",
    "c_sample",
    "a_first_ping",
    "supplier_history_single_city",
    "courier_history_single_city",
    "a_sample",
    "ab_error_report",
    "error_report",
    "threshold_sweep",
    "roc_points",
    "address_floor",
    "legacy_features",
    "c_features",
    "gbt_train_score",
]
ONCE = {"gbt_train_score"}


def seconds(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = local_session("bench")
    start = time.perf_counter()
    fixtures.prepare(spark, sf_dir)
    print("tables written", round(time.perf_counter() - start, 2), file=sys.stderr, flush=True)
    seconds(spark, "c_dwell", sf_dir)  # start-up of the session is not part of any query
    times = {}
    for name in names:
        runs = [seconds(spark, name, sf_dir) for _ in range(1 if name in ONCE else 2)]
        times[name] = round(min(runs), 3)
        print(name, [round(r, 2) for r in runs], file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
