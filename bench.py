"""Time the headline queries and print one JSON line.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "a19_rejection_counts",
    "j01_frame_overlap",
    "j02_overlap_partners",
    "j04_run_pairs",
    "w01_track_age",
    "w05_geometry_history",
    "w09_interval_thinning",
    "a01_centroid",
    "a08_pair_distribution",
    "w06_recovery_matching",
    "w07_recognition_matching",
    "a13_diagnostics_summary",
    "t07_plate_confirmation",
    "s13_bounded_log",
    "a14_greedy_pairs",
    "a21_domain_counters",
    "w04_lost_periods",
    "w14_failure_runs",
    "t11_expired_targets",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 4))
    only = sys.argv[1:]

    from sightline.plans.catalog import QUERIES
    from sightline.session import local_session

    spark = local_session(cpus, "bench", partitions=int(cpus))
    # Warm the JVM and the file cache, so that the first query is not charged for both.
    spark.read.parquet(f"{sf}/lineitem.parquet").groupBy("l_linenumber").count().collect()
    spent: dict[str, float] = {}
    for name in only or HEADLINE:
        started = time.perf_counter()
        QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        spent[name] = round(time.perf_counter() - started, 3)
        print(f"{name}: {spent[name]}", file=sys.stderr, flush=True)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(spent.values()), 3),
                "unit": "sec",
                "queries": spent,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )


if __name__ == "__main__":
    main()
