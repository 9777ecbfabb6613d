"""Benchmark: run the headline queries on $BENCH_SF_DIR with local[$BENCH_CPUS].

Prints one JSON line: {"metric", "value" (total seconds), "unit", "queries", "sf"}.
Every query is executed in full with the no-op sink (no collect to the driver).
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from shroud.plans.queries import QUERIES  # noqa: E402
from shroud.session import INPUT_PARTITIONS, build_session  # noqa: E402

HEADLINE = [
    "regex_spans",
    "gazetteer_spans",
    "hybrid_spans",
    "resolve_overlaps",
    "entity_counts",
    "redact_spans",
    "redact_literal",
    "eval_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    names = sys.argv[1:] or HEADLINE
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = build_session("shroud-bench", {
        "spark.master": f"local[{cpus}]", "spark.driver.memory": os.environ.get("SHROUD_DRIVER_MEMORY", "16g"), "spark.ui.enabled": "false",
        "spark.ui.showConsoleProgress": "false", "spark.sql.shuffle.partitions": cpus, INPUT_PARTITIONS: cpus})
    spark.sparkContext.setLogLevel("ERROR")
    times = {}
    for name in names:
        t0 = time.time()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - t0, 3)
        print(f"{name}: {times[name]}s", file=sys.stderr)
    m = re.search(r"sf([0-9.]+)", sf_dir)
    print(json.dumps({
        "metric": "pii_pipeline_total",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": float(m.group(1)) if m else sf_dir,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
