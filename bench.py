"""Times every registered query; prints one JSON line.

BENCH_SF_DIR (default /root/testdata/sf0.1), BENCH_CPUS (default 8),
BENCH_RUNS (default 2) timed runs per query after one warm-up; the median counts.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import tempfile
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks.queries import queries  # noqa: E402
from worklens.session import local_session  # noqa: E402


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    only = set(sys.argv[1:])
    spark = local_session(cpus, "worklens-bench", shared=tempfile.mkdtemp(prefix="worklens-bench-"))
    spark.sparkContext.setLogLevel("ERROR")

    def run(query) -> float:
        start = time.perf_counter()
        query(spark, sf_dir).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - start

    seconds = {}
    for name, query in queries().items():
        if only and name not in only:
            continue
        run(query)
        seconds[name] = round(statistics.median(run(query) for _ in range(runs)), 4)
    print(
        json.dumps(
            {
                "metric": "sum of the median query times",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
                "cpus": cpus,
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
