"""The three daily rollups, in one pass each or all from one shared pass.

`day_mode_facts` holds sums, counts, minima and maxima at the finest grain any
rollup needs. Facts of disjoint inputs merge by `merge_facts`, so the batch job
scans the readings once for all three tables and the stream adds micro-batches.
Every aggregate buffer has a fixed width, which keeps `HashAggregate` with a
partial step before the shuffle: a hot vehicle costs one row per map task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.functions.signals import date_of, is_charging, low_power_count

_MODE_KEYS = ["vin_id", "date", "clean_mode", "road_mode"]


def vehicle_daily_summary(df: DataFrame) -> DataFrame:
    return df.groupBy("vin_id", date_of().alias("date")).agg(
        F.avg("fuel_percentage").alias("avg_fuel_percentage"),
        F.min("fuel_percentage").alias("min_fuel_percentage"),
        F.max("fuel_percentage").alias("max_fuel_percentage"),
        F.avg("display_speed").alias("avg_display_speed"),
        F.max("display_speed").alias("max_display_speed"),
        F.avg("target_soc").alias("avg_target_soc"),
        F.count(F.lit(1)).alias("record_count"),
        F.min("ts").alias("first_record_time"),
        F.max("ts").alias("last_record_time"),
    )


def charging_behavior_analysis(df: DataFrame) -> DataFrame:
    """`charging_sessions` counts readings while charging, as its source does."""
    charging = is_charging()
    return df.groupBy("vin_id", date_of().alias("date")).agg(
        F.avg("charging_time_remain_minute").alias("avg_charging_time_remain"),
        F.max("charging_time_remain_minute").alias("max_charging_time_remain"),
        F.count_if(charging).alias("charging_sessions"),
        F.avg(F.when(charging, F.col("fuel_percentage"))).alias("avg_fuel_during_charging"),
        F.count(F.lit(1)).alias("total_records"),
    )


def driving_mode_analysis(df: DataFrame) -> DataFrame:
    return df.groupBy("vin_id", date_of().alias("date"), "clean_mode", "road_mode").agg(
        F.count(F.lit(1)).alias("mode_usage_count"),
        F.avg("display_speed").alias("avg_speed_in_mode"),
        F.avg("fuel_percentage").alias("avg_fuel_in_mode"),
        F.sum(low_power_count()).alias("low_power_incidents"),
    )


def day_mode_facts(df: DataFrame) -> DataFrame:
    charging = is_charging()
    fuel_charging = F.when(charging, F.col("fuel_percentage"))
    return df.groupBy("vin_id", date_of().alias("date"), "clean_mode", "road_mode").agg(
        F.count(F.lit(1)).alias("n"),
        F.sum("fuel_percentage").alias("fuel_sum"),
        F.count("fuel_percentage").alias("fuel_n"),
        F.min("fuel_percentage").alias("fuel_min"),
        F.max("fuel_percentage").alias("fuel_max"),
        F.sum(F.col("display_speed").cast("double")).alias("speed_sum"),
        F.count("display_speed").alias("speed_n"),
        F.max("display_speed").alias("speed_max"),
        F.sum("target_soc").alias("soc_sum"),
        F.count("target_soc").alias("soc_n"),
        F.sum("charging_time_remain_minute").alias("charge_sum"),
        F.count("charging_time_remain_minute").alias("charge_n"),
        F.max("charging_time_remain_minute").alias("charge_max"),
        F.count_if(charging).alias("charging_n"),
        F.sum(fuel_charging).alias("charging_fuel_sum"),
        F.count(fuel_charging).alias("charging_fuel_n"),
        F.sum(low_power_count()).alias("low_power"),
        F.min("ts").alias("first_ts"),
        F.max("ts").alias("last_ts"),
    )


def _merged(name: str) -> Column:
    if name.endswith("_min") or name == "first_ts":
        how = F.min
    elif name.endswith("_max") or name == "last_ts":
        how = F.max
    else:
        how = F.sum
    return how(name).alias(name)


def merge_facts(facts: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """Add up facts that share `keys` (all four by default)."""
    keys = keys or _MODE_KEYS
    return facts.groupBy(*keys).agg(*[_merged(c) for c in facts.columns if c not in _MODE_KEYS])


def _mean(total: str, count: str) -> Column:
    return F.try_divide(F.col(total).cast("double"), F.col(count))


def daily_summary_from_facts(facts: DataFrame) -> DataFrame:
    return merge_facts(facts, ["vin_id", "date"]).select(
        "vin_id", "date",
        _mean("fuel_sum", "fuel_n").alias("avg_fuel_percentage"),
        F.col("fuel_min").alias("min_fuel_percentage"),
        F.col("fuel_max").alias("max_fuel_percentage"),
        _mean("speed_sum", "speed_n").alias("avg_display_speed"),
        F.col("speed_max").alias("max_display_speed"),
        _mean("soc_sum", "soc_n").alias("avg_target_soc"),
        F.col("n").alias("record_count"),
        F.col("first_ts").alias("first_record_time"),
        F.col("last_ts").alias("last_record_time"),
    )


def charging_behavior_from_facts(facts: DataFrame) -> DataFrame:
    return merge_facts(facts, ["vin_id", "date"]).select(
        "vin_id", "date",
        _mean("charge_sum", "charge_n").alias("avg_charging_time_remain"),
        F.col("charge_max").alias("max_charging_time_remain"),
        F.col("charging_n").alias("charging_sessions"),
        _mean("charging_fuel_sum", "charging_fuel_n").alias("avg_fuel_during_charging"),
        F.col("n").alias("total_records"),
    )


def driving_mode_from_facts(facts: DataFrame) -> DataFrame:
    return merge_facts(facts).select(
        "vin_id", "date", "clean_mode", "road_mode",
        F.col("n").alias("mode_usage_count"),
        _mean("speed_sum", "speed_n").alias("avg_speed_in_mode"),
        _mean("fuel_sum", "fuel_n").alias("avg_fuel_in_mode"),
        F.col("low_power").alias("low_power_incidents"),
    )
