"""Time the headline queries and print one JSON line.

BENCH_SF_DIR names the data folder, BENCH_CPUS the local cores, BENCH_QUERIES a subset.
"""

from __future__ import annotations

import json
import os
import time

from twinproof.plans import catalogue
from twinproof.session import local_session

HEADLINE = [
    "reconcile_summary",
    "reconcile_full",
    "reconcile_buckets",
    "reconcile_drill",
    "reconcile_multiset",
    "table_profile",
    "profile_diff",
    "ledger_missing",
    "orphan_rows",
    "cdc_apply",
    "cdc_apply_multiset",
    "cdc_apply_stream",
    "rising_errors",
    "failure_streaks",
    "sync_status",
    "rule_checks",
    "settings_diff",
    "schema_draft",
    "conform_rows",
    "fault_matrix",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    names = os.environ["BENCH_QUERIES"].split(",") if os.environ.get("BENCH_QUERIES") else HEADLINE
    spark = local_session(cpus, int(cpus))
    # One untimed pass over the flagship starts the JIT and the file-system cache.
    catalogue.QUERIES["reconcile_summary"](spark, folder).write.format("noop").mode("overwrite").save()
    timings = {}
    for name in names:
        started = time.perf_counter()
        catalogue.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    sf = os.path.basename(folder.rstrip("/")).removeprefix("sf")
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(timings.values()), 3),
                "unit": "sec",
                "queries": timings,
                "sf": float(sf) if sf.replace(".", "", 1).isdigit() else sf,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
