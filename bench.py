"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tramline.plans.queries import QUERIES

HEADLINE = (
    "j1_dangling_stop_ids", "j4_unusable_trips_missing", "j9_crop_trips_in_area", "s_duplicate_keys", "a4_trip_spans", "w5_arrival_before_previous_departure", "w6_distance_not_growing", "w8_overlapping_frequencies",
    "w9_shape_distances", "u2_service_dates", "f_dates", "f_floats", "t13_shifted_trip", "g_gaps_and_islands", "j7_block_overlaps", "j11_repair_cascade_round", "t1_validate_counts",
)
#: A query that takes longer than this is timed once.
ONCE_SECONDS = 20


def main() -> None:
    folder, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in HEADLINE:
        best = float("inf")
        for _ in range(2):
            began = time.time()
            QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            best = min(best, time.time() - began)
            if best > ONCE_SECONDS:
                break
        took[name] = round(best, 3)
    print(json.dumps({"metric": "total best-of-2 seconds of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": os.path.basename(folder.rstrip("/"))}))
    spark.stop()


if __name__ == "__main__":
    main()
