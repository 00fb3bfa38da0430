"""Wall time of every registered query; prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_RUNS`` the timed runs
per query after one untimed warm-up run (the median counts). Results go to Spark's ``noop`` sink, which
computes every row and column.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time
from pathlib import Path

ROOT = Path(__file__).resolve().parent
sys.path.insert(0, str(ROOT))
os.environ["PYTHONPATH"] = os.pathsep.join(
    p for p in (str(ROOT), os.environ.get("PYTHONPATH")) if p)

from roompulse.queries import QUERIES  # noqa: E402
from roompulse.session import local_session  # noqa: E402


def timed(fn, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    fn(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    wanted = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q] or list(QUERIES)
    spark = local_session(cpus, cpus, "bench")
    first, seconds = {}, {}
    for name in wanted:
        first[name] = round(timed(QUERIES[name], spark, sf_dir), 3)
        seconds[name] = round(statistics.median(
            timed(QUERIES[name], spark, sf_dir) for _ in range(runs)), 3)
    rows = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet").count()
            for t in ("events", "orders", "lineitem")}
    spark.stop()
    print(json.dumps({
        "metric": "total wall time of all queries, median of runs", "unit": "sec",
        "value": round(sum(seconds.values()), 3), "queries": seconds, "first_run": first,
        "rows": rows, "cpus": cpus, "sf": Path(sf_dir).name.removeprefix("sf")}))


if __name__ == "__main__":
    main()
