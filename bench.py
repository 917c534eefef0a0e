"""Benchmark the headline queries; prints ONE JSON line.

Env: BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (timed runs per query, default 3; the median is reported after
one warm-up run), BENCH_QUERIES (comma list, default the headline set),
BENCH_SHUFFLE (shuffle partitions, default twice the cores; AQE coalesces).
Each run executes the whole plan with a ``noop`` write (no collect).
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = ("layered_overlay", "overlay_newer", "incremental_sync", "version_reconcile", "package_membership",
            "process_scripts", "assemble", "dependency_closure", "sync_into", "readiness", "overlay_decisions")


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = [q for q in os.environ.get("BENCH_QUERIES", ",".join(HEADLINE)).split(",") if q]

    from strata.plans.catalog import REGISTRY
    from strata.session import get_session
    shuffle = int(os.environ.get("BENCH_SHUFFLE", str(2 * cpus)))
    spark = get_session(f"local[{cpus}]", shuffle_partitions=shuffle, spark__driver__memory="16g",
                        spark__sql__files__maxPartitionBytes=str(64 << 20),
                        spark__checkpoint__dir="file://" + tempfile.mkdtemp(prefix="strata-bench-"))

    def run(name: str) -> float:
        t = time.perf_counter()
        REGISTRY[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - t

    times = {}
    for name in names:
        run(name)  # warm-up: JVM, codegen, file listing caches
        times[name] = round(statistics.median(run(name) for _ in range(runs)), 3)
    sf = os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")
    print(json.dumps({"metric": "sum_median_sec_headline_queries", "value": round(sum(times.values()), 3),
                      "unit": "sec", "queries": times, "sf": sf, "cpus": cpus, "runs": runs, "shuffle_partitions": shuffle,
                      "spark": spark.version}))
    spark.stop()


if __name__ == "__main__":
    main()
