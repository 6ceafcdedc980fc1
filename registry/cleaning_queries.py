"""Cleaning steps, projections, predicates and key functions."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.inputs import RAW, READINGS, Query, on_readings, raw_readings, readings, table
from voltrail.functions.keys import basename
from voltrail.functions.signals import date_of, hour_of, is_charging, low_power_count
from voltrail.operators import cleaning as C
from voltrail.operators.filters import filter_time_range, filter_vehicles
from voltrail.schema import READINGS_COLUMNS, SIGNAL_NAMES
from voltrail.sources.tables import with_day

RAW_NAMES = ", ".join({v: k for k, v in SIGNAL_NAMES.items()}.get(c, c) for c in READINGS_COLUMNS[1:])
TABLE_NAMES = ", ".join(READINGS_COLUMNS[1:])
COLUMNS = ", ".join(READINGS_COLUMNS)
START, END = "2024-01-05 06:00:00", "2024-01-12 00:00:00"


def _drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A drop without `road_mode`, with a wider `target_soc` and a column nobody expects."""
    named = C.add_primary_key(C.rename_signals(C.drop_internal(raw_readings(spark, sf_dir))))
    return named.drop("road_mode").withColumns({
        "target_soc": F.col("target_soc").cast("long"),
        "firmware": F.concat(F.lit("fw"), F.col("channel_id")),
    })


def _rename(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.rename_signals(raw_readings(spark, sf_dir)).withColumn("__primary_key", F.hex("__primary_key"))


def _keyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    return C.add_primary_key(C.rename_signals(C.drop_internal(raw_readings(spark, sf_dir))))


def _building_vehicles(spark: SparkSession, sf_dir: str) -> DataFrame:
    customers = table(spark, sf_dir, "customer").where("c_mktsegment = 'BUILDING'")
    ids = customers.select(F.concat(F.lit("VIN"), F.lpad(F.col("c_custkey").cast("string"), 6, "0")).alias("id"))
    return filter_vehicles(readings(spark, sf_dir), ids)


def _predicates(df: DataFrame) -> DataFrame:
    return df.groupBy("clean_mode").agg(
        F.count_if(is_charging()).alias("charging_rows"),
        F.avg(F.when(is_charging(), F.col("fuel_percentage"))).alias("avg_fuel_charging"),
        F.sum(low_power_count()).alias("low_power_rows"),
    )


def _encoded_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.concat(F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("+copy+"), F.col("page_id").cast("string"))
    return table(spark, sf_dir, "pages").select("page_id", key.alias("key"))


DRIFT_SQL = RAW + """, n AS (SELECT COUNT(*) AS rows, COUNT(DISPLAY_SPEED) AS speeds FROM raw)
SELECT column_name, expected_type, actual_type, status,
       CASE WHEN column_name = 'road_mode' THEN 0 WHEN column_name = 'display_speed' THEN speeds ELSE rows END AS non_null
FROM n, (VALUES
  ('__primary_key', 'string', 'string', 'ok'), ('vin_id', 'string', 'string', 'ok'),
  ('charging_time_remain_minute', 'int', 'int', 'ok'), ('extender_starting_point', 'int', 'int', 'ok'),
  ('fuel_cltc_mileage', 'int', 'int', 'ok'), ('fuel_wltc_mileage', 'int', 'int', 'ok'),
  ('fuel_percentage', 'int', 'int', 'ok'), ('clean_mode', 'int', 'int', 'ok'),
  ('road_mode', 'int', NULL, 'missing'), ('ress_power_low_flag', 'boolean', 'boolean', 'ok'),
  ('target_soc', 'int', 'bigint', 'type_differs'), ('display_speed', 'float', 'float', 'ok'),
  ('channel_id', 'int', 'int', 'ok'), ('endurance_type', 'int', 'int', 'ok'),
  ('ts', 'timestamp', 'timestamp', 'ok'), ('firmware', NULL, 'string', 'unexpected')
) v(column_name, expected_type, actual_type, status)"""

QUERIES = {
    "drop_internal_columns": Query(
        lambda s, d: C.drop_internal(raw_readings(s, d)), RAW + f"SELECT {RAW_NAMES} FROM raw"
    ),
    "rename_signal_columns": Query(
        _rename,
        RAW + "SELECT __primary_key, __sequence, __op_type, "
        + ", ".join(f'{SIGNAL} AS {name}' for SIGNAL, name in zip(RAW_NAMES.split(", "), TABLE_NAMES.split(", ")))
        + " FROM raw",
    ),
    "add_primary_key": Query(
        lambda s, d: _keyed(s, d).select("__primary_key", "vin_id", "ts"),
        RAW + "SELECT concat(vin_id, '_', CAST(ts AS VARCHAR)) AS __primary_key, vin_id, ts FROM raw",
    ),
    "conform_columns": Query(
        lambda s, d: C.conform(_drifted(s, d)),
        READINGS + "SELECT "
        + ", ".join("CAST(target_soc AS BIGINT) AS target_soc" if c == "target_soc" else c
                    for c in READINGS_COLUMNS if c != "road_mode")
        + " FROM readings",
    ),
    "schema_drift_report": Query(lambda s, d: C.schema_drift(_drifted(s, d), profile=True), DRIFT_SQL),
    "clean_readings": Query(
        lambda s, d: C.clean_readings(raw_readings(s, d)), READINGS + f"SELECT {COLUMNS} FROM readings"
    ),
    "date_of_ts": Query(
        on_readings(lambda df: df.groupBy(date_of().alias("date")).agg(F.count(F.lit(1)).alias("n"))),
        READINGS + "SELECT CAST(ts AS DATE) AS date, COUNT(*) AS n FROM readings GROUP BY 1",
    ),
    "hour_bucket": Query(
        on_readings(lambda df: df.groupBy(hour_of().alias("hour")).agg(F.count(F.lit(1)).alias("n"))),
        READINGS + "SELECT date_trunc('hour', ts) AS hour, COUNT(*) AS n FROM readings GROUP BY 1",
    ),
    "case_predicates": Query(
        on_readings(_predicates, "avg_fuel_charging"),
        READINGS + """
SELECT clean_mode, COUNT(CASE WHEN charging_time_remain_minute > 0 THEN 1 END) AS charging_rows,
       ROUND(AVG(CASE WHEN charging_time_remain_minute > 0 THEN fuel_percentage END), 6) AS avg_fuel_charging,
       CAST(SUM(CASE WHEN ress_power_low_flag THEN 1 ELSE 0 END) AS BIGINT) AS low_power_rows
FROM readings GROUP BY clean_mode""",
    ),
    "filter_time_range": Query(
        on_readings(lambda df: filter_time_range(with_day(df), START, END)),
        READINGS + f"""
SELECT {COLUMNS}, CAST(ts AS DATE) AS ts_day FROM readings
WHERE ts >= TIMESTAMP '{START}' AND ts < TIMESTAMP '{END}'""",
    ),
    "filter_vehicles": Query(
        _building_vehicles,
        READINGS + f"""
SELECT {COLUMNS} FROM readings WHERE vin_id IN (
  SELECT concat('VIN', lpad(CAST(c_custkey AS VARCHAR), 6, '0')) FROM customer WHERE c_mktsegment = 'BUILDING')""",
    ),
    "sample_row_keys": Query(
        on_readings(lambda df: C.add_epoch_key(df).select("__primary_key", "vin_id", "ts")),
        READINGS + """
SELECT concat(vin_id, '_', CAST(CAST(floor(epoch_us(ts) / 1000000) AS BIGINT) AS VARCHAR)) AS __primary_key, vin_id, ts
FROM readings""",
    ),
    "url_decode_key": Query(
        lambda s, d: C.url_decode_key(_encoded_pages(s, d), "key"),
        """SELECT page_id, key, url_decode(replace(key, '+', ' ')) AS decoded_key FROM (
  SELECT page_id, replace(url, '/', '%2F') || '+copy+' || CAST(page_id AS VARCHAR) AS key FROM pages)""",
    ),
    "basename_of_path": Query(
        lambda s, d: table(s, d, "pages").select("page_id", basename(F.col("url")).alias("basename")),
        "SELECT page_id, split_part(url, '/', -1) AS basename FROM pages",
    ),
}
