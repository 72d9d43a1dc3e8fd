"""Time the headline queries; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the number of local cores. Each query runs twice
into a sink that discards its rows, and the faster run counts.

    python bench.py            the headline queries, from the tables
    python bench.py --shapes   three operators against plain SQL of the same result, from stages
"""

from __future__ import annotations

import json
import os
import sys
import time

from checks.queries import QUERIES
from tidemark.plans.session import session

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")

HEADLINE = (
    "dataset_totals",
    "daily_access",
    "daily_access_domains",
    "daily_access_events",
    "replica_spans",
    "replica_windows",
    "daily_size",
    "tape_usage",
    "catalog_replicas_daily",
    "merge_reads",
    "read_windows",
    "overrides_applied",
    "override_daily",
    "top_unused",
    "unused_by_campaign",
    "popularity_histogram_wide",
    "rolling_popularity_windows",
)


def timed(build, runs: int = 2) -> float:
    seconds = []
    for _ in range(runs):
        begun = time.perf_counter()
        build().write.format("noop").mode("overwrite").save()
        seconds.append(time.perf_counter() - begun)
    return round(min(seconds), 3)


def main() -> None:
    spark = session(
        "bench",
        f"local[{CPUS}]",
        partitions=int(CPUS),
        **{
            "spark.checkpoint.dir": os.environ.get("SHARED_DIR", "/tmp/tidemark-shared"),
            "spark.ui.enabled": "false",
            "spark.ui.showConsoleProgress": "false",
            "spark.driver.memory": "16g",
            "spark.sql.shuffle.partitions": CPUS,
        },
    )
    spark.sparkContext.setLogLevel("ERROR")
    if "--shapes" in sys.argv:
        from checks.shapes import compare_shapes

        result = compare_shapes(spark, SF_DIR, timed)
    else:
        seconds = {name: timed(lambda: QUERIES[name](spark, SF_DIR)) for name in HEADLINE}
        result = {
            "metric": "total_query_seconds",
            "value": round(sum(seconds.values()), 3),
            "unit": "sec",
            "queries": {name: seconds[name] for name in HEADLINE},
        }
    print(json.dumps({**result, "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
