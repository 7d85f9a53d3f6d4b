"""Times all queries of the event log: one JSON line, median of three warm runs each;
the value is the sum over the headline queries."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from strandlog.queries import queries

HEADLINE = ["q01_sequence", "q08_heads", "q09_status", "q10_by_status", "q12_labels", "q14_counter", "q15_orders", "q16_running", "q18_snapshot_tail", "q20_append", "q22_retained", "q24_archive", "q29_label_values"]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in queries():
        runs = []
        for _ in range(4):
            began = time.perf_counter()
            queries()[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            runs.append(time.perf_counter() - began)
        took[name] = round(statistics.median(runs[1:]), 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(took[q] for q in HEADLINE), 3), "unit": "sec", "queries": took, "sf": os.path.basename(sf_dir.rstrip("/"))}))


if __name__ == "__main__":
    main()
