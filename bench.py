"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR names the tables (default sf0.1), BENCH_CPUS the local cores, and
BENCH_RUNS the number of warm runs, of which the median counts. Archives, table
writes and streams are timed once each, under `also`; they are not in the total.
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.catalogue import all_queries
from registry.inputs import table
from voltrail.functions.signals import primary_key
from voltrail.operators.rollups import day_mode_facts, driving_mode_analysis, vehicle_daily_summary
from voltrail.operators.measures import trend_hourly_fuel_speed
from voltrail.operators.sessions import charging_sessions_true
from voltrail.session import build_session

HEADLINE = [
    "vehicle_daily_summary", "charging_behavior_analysis", "driving_mode_analysis", "kpi_active_vehicles",
    "kpi_avg_fuel", "trend_hourly_fuel_speed", "table_vehicle_soc_speed_charging_cltc", "mode_distribution",
    "clean_readings", "dedup_readings_by_key", "filter_time_range", "vehicle_latest_status", "speed_profile",
    "speed_anomalies", "charging_sessions_true", "drill_down", "multi_dim_performance", "trend_moving_average",
    "content_digests", "duplicate_content", "unpack_event_envelope", "dashboard_complete",
]


def lineitem_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`lineitem` as telemetry: six times the rows of `events`."""
    rows = table(spark, sf_dir, "lineitem").select(
        F.concat(F.lit("VIN"), F.col("l_suppkey").cast("string")).alias("vin_id"),
        F.when(F.col("l_returnflag") == "R", F.col("l_quantity").cast("int")).otherwise(0).alias("charging_time_remain_minute"),
        F.col("l_quantity").cast("int").alias("fuel_percentage"),
        (F.col("l_linenumber") % 3).alias("clean_mode"),
        (F.col("l_linenumber") % 4).alias("road_mode"),
        (F.col("l_quantity") < 3).alias("ress_power_low_flag"),
        (F.col("l_quantity") + 40).cast("int").alias("target_soc"),
        F.col("l_tax").cast("float").alias("display_speed"),
        F.col("l_shipdate").cast("timestamp").alias("ts"),
    )
    return rows.withColumn("__primary_key", primary_key())


ALSO = [
    "extract_archives", "verify_member_crc", "unpack_from_messages", "load_drifted_drops", "ctas_partitioned",
    "replace_table", "stream_daily_summary", "stream_dedup_ingest",
]

LINEITEM = {
    "lineitem_vehicle_daily_summary": vehicle_daily_summary,
    "lineitem_driving_mode_analysis": driving_mode_analysis,
    "lineitem_day_mode_facts": day_mode_facts,
    "lineitem_trend_hourly_fuel_speed": trend_hourly_fuel_speed,
    "lineitem_charging_sessions_true": charging_sessions_true,
}


def timed(make) -> float:
    start = time.perf_counter()
    make().write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> int:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    spark = build_session(
        "bench", f"local[{cpus}]",
        **{"spark.sql.shuffle.partitions": cpus, "spark.driver.memory": "8g", "spark.ui.showConsoleProgress": "false"},
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    jobs = {name: (lambda q=registered[name]: q.run(spark, sf_dir)) for name in HEADLINE}
    jobs |= {name: (lambda op=op: op(lineitem_readings(spark, sf_dir))) for name, op in LINEITEM.items()}
    seconds = {}
    for name, make in jobs.items():
        timed(make)
        seconds[name] = round(statistics.median(timed(make) for _ in range(runs)), 4)
        print(f"{name}: {seconds[name]}", file=sys.stderr)
    also = {name: round(timed(lambda q=registered[name]: q.run(spark, sf_dir)), 4) for name in ALSO}
    print(json.dumps({
        "metric": "telemetry_queries_total",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "also": also,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main())
