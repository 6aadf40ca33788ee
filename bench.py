"""Headline timings: ingest, rollup build, and answers from the rollup against raw scans.

Prints one JSON line. BENCH_SF_DIR (default sf0.1) and BENCH_CPUS choose data and cores.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import functions as F  # noqa: E402

from waveloom import builder  # noqa: E402
from waveloom.operators import rollup as roll  # noqa: E402
from waveloom.operators import stats as st  # noqa: E402
from waveloom.operators.envelope import envelope  # noqa: E402
from waveloom.queries import all_queries  # noqa: E402
from waveloom.queries.base import event_store, lineitem_rollup, lineitem_store, ranges_of  # noqa: E402

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
REPEATS = 3
NAMED = ["plot_view", "stats_table", "cursor_values", "values_page", "export_wide", "xy_decimate", "is_monotonic", "nearest_xarr",
         "run_compress", "interval_merge", "stream_rollup", "channels", "file_scan_float", "time_reference", "fmt_float"]


def drain(df) -> None:
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = (
        builder("bench").master(f"local[{CPUS}]").config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "8g").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times: dict[str, float] = {}

    def clock(name, run, repeats=1):
        best = None
        for _ in range(repeats):
            t = time.perf_counter()
            run()
            took = time.perf_counter() - t
            best = took if best is None else min(best, took)
        times[name] = round(best, 3)

    clock("ingest_lineitem", lambda: lineitem_store(spark, SF_DIR))
    clock("ingest_events", lambda: event_store(spark, SF_DIR))
    s = lineitem_store(spark, SF_DIR)
    clock("rollup_build", lambda: lineitem_rollup(spark, SF_DIR))
    buckets, base, n = lineitem_rollup(spark, SF_DIR), 16, s.n_channels
    ranges = ranges_of(s.channels)
    wide = ranges.withColumn("b", F.lit(1024).cast("bigint"))
    clock("range_stats_raw", lambda: drain(st.range_stats(s.samples, s.channels, n_channels=n)), REPEATS)
    clock("range_stats_rollup", lambda: drain(st.with_statistics(
        roll.range_states(s.samples, buckets, s.channels, ranges, base, n))), REPEATS)
    clock("envelope_raw", lambda: drain(envelope(s.samples, wide, n)), REPEATS)
    clock("envelope_rollup", lambda: drain(roll.rollup_envelope(s.samples, buckets, s.channels, wide, base, n)), REPEATS)
    found = all_queries()
    for name in NAMED:
        clock(name, lambda name=name: drain(found[name](spark, SF_DIR)), 2)
    print(json.dumps({"metric": "total_seconds", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
