"""Benchmark: load the star once, then run every registered analysis query.

    BENCH_SF_DIR=/root/testdata/sf0.1 BENCH_CPUS=8 python bench.py

Each query is built and executed in full through the ``noop`` sink (nothing
is collected to the driver). Every query runs once untimed (JVM and codegen
warm-up) and is then built again from scratch and timed; no result is reused
between the two runs. Prints one JSON line:
{"metric": "total_query_sec", "value": N, "unit": "sec", "queries": {...}, "sf": ...,
 "cold_value": first-run total, "cold_queries": {...}}
"""

from __future__ import annotations

import json
import os
import re
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

# round trips through CSV/Parquet measure file I/O, not query work
SKIP = {"src_star", "sink_star"}


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    only = [q for q in sys.argv[1:] if not q.startswith("-")]

    from ledgerline.registry import QUERIES
    from ledgerline.session import build_session
    from ledgerline.sources.warehouse import star_for

    parts = int(os.environ.get("BENCH_SHUFFLE_PARTITIONS", str(cpus * 2)))
    spark = build_session(f"local[{cpus}]", shuffle_partitions=parts)

    t0 = time.perf_counter()
    star_for(spark, sf_dir)
    load = time.perf_counter() - t0

    warm = os.environ.get("BENCH_WARMUP", "1") != "0"
    timings: dict[str, float] = {}
    cold: dict[str, float] = {}
    for name, query in QUERIES.items():
        if name in SKIP or (only and name not in only):
            continue
        if warm:
            t0 = time.perf_counter()
            query(spark, sf_dir).write.format("noop").mode("overwrite").save()
            cold[name] = round(time.perf_counter() - t0, 3)
        t0 = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - t0, 3)

    match = re.search(r"sf([0-9.]+)", sf_dir)
    out = {
        "metric": "total_query_sec",
        "value": round(sum(timings.values()), 3),
        "unit": "sec",
        "queries": timings,
        "load_star_sec": round(load, 3),
        "sf": float(match.group(1)) if match else sf_dir,
        "cpus": cpus,
        "warmup": warm,
        "cold_value": round(sum(cold.values()), 3) if cold else None,
        "cold_queries": cold or None,
    }
    print(json.dumps(out))
    spark.stop()


if __name__ == "__main__":
    main()
