"""Fixed schemas, name maps and sample rows of the telemetry model."""

from __future__ import annotations

from datetime import datetime, timezone

from pyspark.sql import types as T

# The readings table, in table order.
READINGS_SCHEMA = T.StructType([
    T.StructField("__primary_key", T.StringType()),
    T.StructField("vin_id", T.StringType()),
    T.StructField("charging_time_remain_minute", T.IntegerType()),
    T.StructField("extender_starting_point", T.IntegerType()),
    T.StructField("fuel_cltc_mileage", T.IntegerType()),
    T.StructField("fuel_wltc_mileage", T.IntegerType()),
    T.StructField("fuel_percentage", T.IntegerType()),
    T.StructField("clean_mode", T.IntegerType()),
    T.StructField("road_mode", T.IntegerType()),
    T.StructField("ress_power_low_flag", T.BooleanType()),
    T.StructField("target_soc", T.IntegerType()),
    T.StructField("display_speed", T.FloatType()),
    T.StructField("channel_id", T.IntegerType()),
    T.StructField("endurance_type", T.IntegerType()),
    T.StructField("ts", T.TimestampType()),
])
READINGS_COLUMNS = READINGS_SCHEMA.names

# Raw signal name -> table column.
SIGNAL_NAMES = {
    "Charging_Time_Remain_Minute": "charging_time_remain_minute",
    "Extender_Starting_Point": "extender_starting_point",
    "Fuel_CLTC_Mileage": "fuel_cltc_mileage",
    "Fuel_WLTC_Mileage": "fuel_wltc_mileage",
    "Fuel_Percentage": "fuel_percentage",
    "Clean_Mode": "clean_mode",
    "Road_Mode": "road_mode",
    "RESS_Power_Low_Flag": "ress_power_low_flag",
    "Target_SOC": "target_soc",
    "DISPLAY_SPEED": "display_speed",
    "Endurance_Type": "endurance_type",
}

# Columns the upstream store adds for itself.
INTERNAL_COLUMNS = ["__sequence", "__op_type", "__primary_key"]

# A raw drop as it lands: signal names in mixed case plus the internal columns.
RAW_SCHEMA = T.StructType(
    [
        T.StructField("__primary_key", T.BinaryType()),
        T.StructField("__sequence", T.LongType()),
        T.StructField("__op_type", T.IntegerType()),
    ]
    + [
        T.StructField({v: k for k, v in SIGNAL_NAMES.items()}.get(f.name, f.name), f.dataType)
        for f in READINGS_SCHEMA
        if f.name != "__primary_key"
    ]
)

# The signals of a raw drop: what a load reads, by name and whatever the case, from every drop.
SIGNAL_SCHEMA = T.StructType([f for f in RAW_SCHEMA if f.name not in INTERNAL_COLUMNS])

# The two literal test rows, key and `ts` left out.
SAMPLE_SIGNALS = [
    ("TEST001", 120, 50, 500, 480, 75, 1, 2, False, 80, 60.5, 1, 1),
    ("TEST002", 90, 30, 450, 430, 60, 0, 1, True, 70, 45.2, 2, 2),
]
SAMPLE_INSTANT = datetime(2024, 1, 1, tzinfo=timezone.utc)

# Message body of a storage notification.
ENVELOPE_SCHEMA = "struct<Records: array<struct<s3: struct<object: struct<key: string>>>>>"

# Column sets of the business-intelligence datasets.
BI_COLUMNS_9 = [
    "__primary_key", "vin_id", "charging_time_remain_minute", "fuel_percentage",
    "display_speed", "clean_mode", "road_mode", "ress_power_low_flag", "ts",
]
BI_COLUMNS_7 = [
    "vin_id", "fuel_percentage", "display_speed", "charging_time_remain_minute",
    "clean_mode", "road_mode", "ts",
]
