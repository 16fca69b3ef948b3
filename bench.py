"""Headline queries at ``$BENCH_SF_DIR`` on ``local[$BENCH_CPUS]``; prints one JSON line.

Each query runs once to warm up and then three times; the median counts.  Results go to the no-op sink, so a
query is timed to its last row without a collect.
"""

from __future__ import annotations

import json
import os
import shutil
import sys
import tempfile
import time
from statistics import median

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
RUNS = 3


def main() -> None:
    from pyspark.sql import functions as F

    from tallyforge.plans.catalogue import QUERIES
    from tallyforge.session import session
    from tallyforge.sources import logs, parts

    scratch = tempfile.mkdtemp(prefix="bench-")
    spark = session("bench", f"local[{CPUS}]", spark__sql__shuffle__partitions=CPUS, spark__ui__enabled="false", spark__driver__memory="8g", spark__checkpoint__dir=f"{scratch}/checkpoints", spark__sql__warehouse__dir=f"{scratch}/warehouse")
    spark.sparkContext.setLogLevel("ERROR")
    took: dict[str, float] = {}

    def timed(name: str, run) -> None:
        times = []
        for i in range(RUNS + 1):
            began = time.perf_counter()
            run()
            times.append(time.perf_counter() - began)
        took[name] = round(median(times[1:]), 4)

    sink = lambda df: df.write.format("noop").mode("overwrite").save()
    for name in ("q01_count_all", "q02_count_gt", "q03_sum_gt", "q05_max", "q06_range_count", "q07_contains_count", "q09_gt_and_contains", "q10_lite_count", "q13_granule_index", "q15_merge_parts", "q17_occurrences", "q18_indicator_report", "q21_group_by", "q22_top_k", "q23_fact_dimension", "q24_as_of", "q26_drift", "q27_json_field"):
        timed(name, lambda name=name: sink(QUERIES[name](spark, SF_DIR)))

    # the published micro-benchmarks, at their own sizes
    records, log = logs.made_records(spark, 1_850_000), f"{scratch}/log"
    logs.made_weblog(spark, 1_600_000).write.text(log)  # about 100 MB
    timed("ingest_sorted_1850k_rows", lambda: parts.write_part(records, f"{scratch}/part", mode="overwrite"))
    timed("parse_weblog_100mb", lambda: sink(logs.parse_weblog(logs.read_lines(spark, log, with_file=False))))
    part = parts.read_part(spark, f"{scratch}/part")
    timed("filtered_count_1850k_rows", lambda: part.filter("value > 100").count())
    timed("skipped_range_count_1850k_rows", lambda: part.filter("ts between 900000 and 900020").count())
    from tallyforge.operators.scanning import indicator_report

    timed("scan_3_patterns_100mb", lambda: sink(indicator_report(logs.read_lines(spark, log, with_file=False), "line", logs.INDICATORS)))
    n = spark.read.parquet(f"{SF_DIR}/events.parquet").agg(F.count(F.lit(1))).first()[0]
    print(json.dumps({"metric": "total_seconds", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": SF_DIR, "cpus": int(CPUS), "events": n}))
    spark.stop()
    shutil.rmtree(scratch, ignore_errors=True)


if __name__ == "__main__":
    main()
