"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query is run in full into the no-op sink, twice; the better time counts, so JVM warm-up does not.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from barloom.catalog import load_all  # noqa: E402
from barloom.session import build_session  # noqa: E402

HEADLINE = [
    "w20_momentum",
    "w9_ts_rank",
    "w6_sma",
    "r1_rank",
    "r3_quantile_groups",
    "a26_zscore_composite",
    "c1_panel",
    "c2_alpha_batch",
    "c6_group_returns",
    "c5d_backtest_ic",
    "a6_bar_completeness",
    "c11_bar_check",
    "a33d_grid_market",
    "u3_version_pick",
    "j11_row_diff",
    "c13_report_load",
    "s11_wide_to_long_sink",
    "j15_source_fallback",
]


def main() -> None:
    sf = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    spark = build_session(f"local[{cpus}]", "bench", int(cpus) if cpus.isdigit() else 8)
    queries = load_all()[0]
    names = sys.argv[1:] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        best = None
        for _ in range(runs):
            t = time.perf_counter()
            queries[name](spark, sf).write.format("noop").mode("overwrite").save()
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)
    print(
        json.dumps(
            {
                "metric": "headline_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf.rstrip("/")),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
