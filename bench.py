"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the data folder, ``BENCH_CPUS`` the local threads, ``BENCH_QUERIES`` an
optional comma-separated list (``all`` for every registered query).
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from lapspark.plans import QUERIES
from lapspark.session import build_session, drop_materialized

HEADLINE = [
    "gap_to_leader", "clean_laps", "rolling_pace", "rolling_pace_median", "pace_summary", "lap_positions",
    "detect_undercuts", "undercut_windows", "stint_degradation", "project_finish", "project_finish_simple",
    "resample", "lap_features", "fastest_lap_traces", "microsectors", "normalised_profile", "percentile_rank",
    "cosine_topk", "audit_cost", "validate_report",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = list(QUERIES) if chosen == "all" else chosen.split(",") if chosen else HEADLINE
    spark = build_session(
        "bench", f"local[{cpus}]",
        spark__sql__shuffle__partitions=cpus, spark__ui__enabled="false", spark__driver__memory="16g",
        spark__checkpoint__dir=tempfile.mkdtemp(prefix="lapspark-bench-"),
    )
    spark.sparkContext.setLogLevel("ERROR")
    # One untimed query starts the executors and loads the code paths.
    QUERIES["fastest_laps"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        begin = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - begin, 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    drop_materialized(spark)
    spark.stop()


if __name__ == "__main__":
    main()
