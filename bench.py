"""Time the queries and print one JSON line.

BENCH_SF_DIR, BENCH_CPUS, BENCH_REPEATS and BENCH_QUERIES (comma-separated
names) select what is run; results go to a sink that discards them.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from opinionmill.session import get_session  # noqa: E402
from workload import fixtures  # noqa: E402
from workload.queries import QUERIES  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "1"))
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or list(QUERIES)
    spark = get_session(
        f"local[{cpus}]", int(cpus) if cpus.isdigit() else 8,
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
        spark__driver__memory="12g")
    spark.sparkContext.setLogLevel("ERROR")
    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    sink(fixtures.opinions(spark, sf_dir))  # start-up cost is not a query's
    seconds = {}
    for name in names:
        times = []
        for _ in range(repeats):
            start = time.perf_counter()
            sink(QUERIES[name](spark, sf_dir))
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times), 3)
        print(f"{seconds[name]:8.2f} {name}", file=sys.stderr, flush=True)
    print(json.dumps({
        "metric": "total_query_seconds", "value": round(sum(seconds.values()), 3),
        "unit": "sec", "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
