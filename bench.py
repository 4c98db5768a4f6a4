"""Time the headline queries; prints one JSON line.

Each query runs twice in one session: ``cold`` includes compiling its plan for the first
time, ``queries`` holds the second run. Results are computed in full and discarded.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

HEADLINES = (
    "U7_usage_table",
    "U8_latest_state",
    "P5_inventory",
    "P9_yearly_cost",
    "P12_divested_averages",
    "D2_midpoint_average",
    "D4_daily_cost_asof",
    "L1_item_listing",
    "L3_category_listing_totals",
    "L5_use_bands",
    "H4_total_steps",
    "W6_change_by_user",
    "W8_wardrobe_metrics",
    "K1_secondhand_share",
    "B4_wear_tiers",
    "B8_price_stats",
    "B9_ranked_wears",
    "G4_cpw_summary",
    "M2_wpm_category",
    "M5_category_wears",
    "R1_wears_by_price",
    "R4_repair_kind_by_category",
    "Q3_cowear_pairs",
)


def timed(spark, query, sf_dir: str) -> float:
    begin = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return round(time.perf_counter() - begin, 3)


def main() -> None:
    from registry import QUERIES

    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("wearlog-bench")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", "16g")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    cold, warm = {}, {}
    for name in HEADLINES:
        cold[name] = timed(spark, QUERIES[name], sf_dir)
        warm[name] = timed(spark, QUERIES[name], sf_dir)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(warm.values()), 3),
                "unit": "sec",
                "queries": warm,
                "cold": cold,
                "sf": os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
