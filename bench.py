"""Benchmark: run every catalogue query over $BENCH_SF_DIR on
local[$BENCH_CPUS] and print ONE JSON line.

Each query is executed in full with the ``noop`` sink (the whole plan runs,
nothing is collected to the driver).  After one warm-up pass, each query is
timed ``$BENCH_REPEAT`` times (default 3) and the median is reported; the
number of shuffle exchanges in the physical plan is reported too, and (unless
``BENCH_REPORT=0``) the time of the production runner writing every output
(``report_all_outputs_sec``).
"""

from __future__ import annotations

import json
import os
import re
import statistics
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from revlens.plans.catalog import catalogue  # noqa: E402
from revlens.session import build_session  # noqa: E402


def _sf_of(path: str) -> float | str:
    m = re.search(r"sf([0-9.]+)", path)
    return float(m.group(1)) if m else path


def _exchanges(df) -> int:
    """Shuffle exchanges in the physical plan before adaptive re-planning."""
    plan = df._jdf.queryExecution().executedPlan().toString()
    return len(re.findall(r"(?<!Broadcast)Exchange (hashpartitioning|SinglePartition|rangepartitioning|"
                          r"RoundRobinPartitioning)", plan))


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeat = int(os.environ.get("BENCH_REPEAT", "3"))
    only = [q for q in os.environ.get("BENCH_QUERIES", "").split(",") if q]
    spark = build_session(f"local[{cpus}]", shuffle_partitions=int(cpus))
    qs = catalogue()
    names = only or list(qs)

    for name in names:  # warm-up: JIT, file listing, parquet footers
        qs[name](spark, sf_dir).write.format("noop").mode("overwrite").save()

    times: dict[str, float] = {}
    exchanges: dict[str, int] = {}
    for name in names:
        runs = []
        for _ in range(repeat):
            df = qs[name](spark, sf_dir)
            t0 = time.perf_counter()
            df.write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - t0)
        times[name] = round(statistics.median(runs), 4)
        try:
            exchanges[name] = _exchanges(qs[name](spark, sf_dir))
        except Exception:  # noqa: BLE001
            pass
    report_sec = None
    if os.environ.get("BENCH_REPORT", "1") == "1" and not only:
        # Production path: all outputs from checkpointed shared tables, written as parquet.
        import tempfile
        from revlens.plans.catalog import Feeds
        from revlens.session import ensure_checkpoint_dir
        ensure_checkpoint_dir(spark, tempfile.mkdtemp(prefix="revlens-bench-ckpt-"))
        from revlens.plans.report import run_report
        out = tempfile.mkdtemp(prefix="revlens-bench-report-")
        t0 = time.perf_counter()
        run_report(Feeds(spark, sf_dir), out)
        report_sec = round(time.perf_counter() - t0, 4)
    spark.stop()
    print(json.dumps({
        "metric": "sum_of_median_query_seconds",
        "value": round(sum(times.values()), 4),
        "unit": "sec",
        "queries": times,
        "exchanges": exchanges,
        "sf": _sf_of(sf_dir),
        "cpus": int(cpus),
        "repeat": repeat,
        "report_all_outputs_sec": report_sec,
    }))


if __name__ == "__main__":
    main()
