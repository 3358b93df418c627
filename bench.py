"""Benchmark the headline plans.

Runs each plan at ``$BENCH_SF_DIR`` (default /root/testdata/sf0.1) on
``local[$BENCH_CPUS]`` and prints one JSON line.  Each plan is fully executed
through the ``noop`` sink, so results are computed but never collected.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# Headline plans, one per step of the reference's workflow (clean, process,
# freeze/assemble, features, split, evaluate, monitor, gate, profile).
HEADLINE = [
    "clean_orders", "row_id", "merge_left", "assemble", "pit_mean", "fill_dates",
    "split_exact", "classification_metrics", "regression_metrics", "roc_auc",
    "drift_all", "quality_report", "profile", "gate_decision", "train_score",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    from tabsmith.session import build_session

    spark = build_session(f"local[{cpus}]", int(cpus) * 2, extra={
        "spark.driver.memory": os.environ.get("BENCH_DRIVER_MEMORY", "16g"),
        "spark.eventLog.enabled": "false",
    })
    spark.sparkContext.setLogLevel("ERROR")
    if not spark.sparkContext.getCheckpointDir():
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="bench-ckpt-"))
    from tabsmith.plans.registry import QUERIES

    # warm-up: JVM class loading and the parquet footer cache
    QUERIES["value_distribution"](spark, sf_dir).write.format("noop").mode("overwrite").save()
    times = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - t0, 3)
    sf = os.path.basename(sf_dir.rstrip("/")).replace("sf", "")
    print(json.dumps({"metric": "headline_plans_total_wall", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": float(sf) if sf else sf_dir,
                      "cpus": int(cpus)}))
    spark.stop()


if __name__ == "__main__":
    main()
