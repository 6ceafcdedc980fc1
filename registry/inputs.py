"""The given tables in the shapes the operators expect, in Spark and in SQL."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions.signals import primary_key
from voltrail.schema import RAW_SCHEMA, READINGS_COLUMNS, SIGNAL_NAMES


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


# Schemas of the given tables in use; naming them spares a look at a footer per query.
TABLES = {
    "customer": "c_custkey bigint, c_name string, c_nationkey int, c_acctbal double, c_mktsegment string",
    "documents": "doc_id bigint, text string, lang string, source string, n_chars bigint",
    "events": "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, value double, props string",
    "labels": "doc_id bigint, quality int, toxic int",
    "lineitem": "l_orderkey bigint, l_partkey bigint, l_suppkey bigint, l_linenumber int, l_quantity double, "
                "l_extendedprice double, l_discount double, l_tax double, l_returnflag string, "
                "l_linestatus string, l_shipdate timestamp_ntz",
    "pages": "page_id bigint, url string, html string",
}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def as_readings(events: DataFrame) -> DataFrame:
    """`events` as telemetry: the user is the vehicle, `k` drives the signals."""
    k = F.col("k")
    signals = events.withColumn("k", F.get_json_object("props", "$.k").cast("int")).select(
        F.concat(F.lit("VIN"), F.lpad(F.col("user_id").cast("string"), 6, "0")).alias("vin_id"),
        F.when(F.col("event_type") == "purchase", k).otherwise(0).alias("charging_time_remain_minute"),
        (k % 50).alias("extender_starting_point"),
        (k + 400).alias("fuel_cltc_mileage"),
        (k * 2 % 100 + 360).alias("fuel_wltc_mileage"),
        k.alias("fuel_percentage"),
        (F.col("event_id") % 3).cast("int").alias("clean_mode"),
        (F.col("event_id") % 4).cast("int").alias("road_mode"),
        (k < 10).alias("ress_power_low_flag"),
        (k % 41 + 60).alias("target_soc"),
        F.when(F.col("event_type") != "error", F.col("value").cast("float")).alias("display_speed"),
        (F.col("user_id") % 8).cast("int").alias("channel_id"),
        (F.col("event_id") % 2).cast("int").alias("endurance_type"),
        F.col("ts").cast("timestamp").alias("ts"),
    )
    return signals.withColumn("__primary_key", primary_key()).select(*READINGS_COLUMNS)


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_readings(table(spark, sf_dir, "events"))


def readings_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return as_readings(
        spark.readStream.schema(TABLES["events"]).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    )


def as_raw(df: DataFrame) -> DataFrame:
    """Readings as a raw drop: signal names in mixed case and the store's own columns."""
    raw_name = {v: k for k, v in SIGNAL_NAMES.items()}
    signals = df.toDF(*[raw_name.get(c, c) for c in df.columns])
    return signals.withColumns({
        "__primary_key": F.unhex(F.md5("__primary_key")),
        "__sequence": F.unix_micros("ts"),
        "__op_type": F.lit(1),
    }).select(*RAW_SCHEMA.names)


def raw_readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return as_raw(readings(spark, sf_dir))


def rounded(df: DataFrame, *columns: str) -> DataFrame:
    """Sums of floating-point values depend on their order; six decimals do not."""
    return df.withColumns({c: F.round(c, 6) for c in columns})


def on_readings(op: Callable[[DataFrame], DataFrame], *round_columns: str) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, sf_dir: rounded(op(readings(spark, sf_dir)), *round_columns)


READINGS = """WITH readings AS (
  SELECT concat(vin_id, '_', CAST(ts AS VARCHAR)) AS __primary_key, * FROM (
    SELECT concat('VIN', lpad(CAST(user_id AS VARCHAR), 6, '0')) AS vin_id,
           CASE WHEN event_type = 'purchase' THEN k ELSE 0 END AS charging_time_remain_minute,
           CAST(k % 50 AS INT) AS extender_starting_point,
           CAST(400 + k AS INT) AS fuel_cltc_mileage,
           CAST(360 + (k * 2) % 100 AS INT) AS fuel_wltc_mileage,
           k AS fuel_percentage,
           CAST(event_id % 3 AS INT) AS clean_mode,
           CAST(event_id % 4 AS INT) AS road_mode,
           k < 10 AS ress_power_low_flag,
           CAST(60 + k % 41 AS INT) AS target_soc,
           CASE WHEN event_type = 'error' THEN NULL ELSE CAST(value AS FLOAT) END AS display_speed,
           CAST(user_id % 8 AS INT) AS channel_id,
           CAST(event_id % 2 AS INT) AS endurance_type,
           CAST(ts AS TIMESTAMP) AS ts
    FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events) e) c
)
"""

RAW = READINGS.rstrip() + """, raw AS (
  SELECT upper(md5(__primary_key)) AS __primary_key, epoch_us(ts) AS __sequence, 1 AS __op_type, vin_id,
         charging_time_remain_minute AS Charging_Time_Remain_Minute,
         extender_starting_point AS Extender_Starting_Point,
         fuel_cltc_mileage AS Fuel_CLTC_Mileage, fuel_wltc_mileage AS Fuel_WLTC_Mileage,
         fuel_percentage AS Fuel_Percentage, clean_mode AS Clean_Mode, road_mode AS Road_Mode,
         ress_power_low_flag AS RESS_Power_Low_Flag, target_soc AS Target_SOC,
         display_speed AS DISPLAY_SPEED, channel_id, endurance_type AS Endurance_Type, ts
  FROM readings
)
"""
