"""Dashboard queries: an aggregate over the fleet, per vehicle, per hour or per mode."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions.signals import date_of, hour_of

FUEL = "fuel_percentage"
SPEED = "display_speed"
SOC = "target_soc"
CHARGING = "charging_time_remain_minute"
CLTC = "fuel_cltc_mileage"
WLTC = "fuel_wltc_mileage"


# Dashboard averages: query -> (dimension, averaged columns).
AVERAGES: dict[str, tuple[str | None, tuple[str, ...]]] = {
    "kpi_avg_fuel": (None, (FUEL,)),
    "kpi_avg_speed": (None, (SPEED,)),
    "kpi_avg_soc": (None, (SOC,)),
    "kpi_avg_charging": (None, (CHARGING,)),
    "by_vehicle_fuel": ("vin_id", (FUEL,)),
    "by_vehicle_speed": ("vin_id", (SPEED,)),
    "by_vehicle_soc": ("vin_id", (SOC,)),
    "by_vehicle_charging": ("vin_id", (CHARGING,)),
    "by_vehicle_cltc_wltc": ("vin_id", (CLTC, WLTC)),
    "scatter_speed_fuel": ("vin_id", (SPEED, FUEL)),
    "table_vehicle_fuel_speed": ("vin_id", (FUEL, SPEED)),
    "table_vehicle_fuel_speed_charging": ("vin_id", (FUEL, SPEED, CHARGING)),
    "table_vehicle_soc_speed_charging": ("vin_id", (SOC, SPEED, CHARGING)),
    "table_vehicle_soc_speed_charging_cltc": ("vin_id", (SOC, SPEED, CHARGING, CLTC)),
    "trend_hourly_fuel_speed": ("hour", (FUEL, SPEED)),
    "trend_hourly_fuel": ("hour", (FUEL,)),
    "trend_hourly_speed": ("hour", (SPEED,)),
    "trend_hourly_soc": ("hour", (SOC,)),
    "trend_hourly_charging": ("hour", (CHARGING,)),
}


def measure(df: DataFrame, averages: Sequence[str], dims: Sequence[str | Column] = ()) -> DataFrame:
    """`AVG` of each named column by `dims`; the result columns are `avg_<name>`."""
    return df.groupBy(*dims).agg(*[F.avg(c).alias(f"avg_{c}") for c in averages])


def average(key: str) -> Callable[[DataFrame], DataFrame]:
    dim, columns = AVERAGES[key]

    def query(df: DataFrame) -> DataFrame:
        dims = {None: [], "vin_id": ["vin_id"], "hour": [hour_of().alias("hour")]}[dim]
        return measure(df, columns, dims)

    return query


def kpi_active_vehicles(df: DataFrame, approximate: bool = False) -> DataFrame:
    count = F.approx_count_distinct if approximate else F.count_distinct
    return df.agg(count("vin_id").alias("active_vehicles"))


def gauge_avg_charging(df: DataFrame) -> DataFrame:
    return df.agg(
        F.avg(CHARGING).alias("avg_charging_time_remain_minute"),
        F.min(CHARGING).alias("min_charging_time_remain_minute"),
        F.max(CHARGING).alias("max_charging_time_remain_minute"),
    )


def mode_distribution(df: DataFrame) -> DataFrame:
    """Readings with a vehicle id per `clean_mode`, and their share of all such readings."""
    modes = df.groupBy("clean_mode").agg(F.count("vin_id").alias("vehicle_records"))
    total = modes.agg(F.sum("vehicle_records")).scalar()
    return modes.withColumn("share", F.try_divide(F.col("vehicle_records"), total))


def kpi_active_vehicles_diff(df: DataFrame) -> DataFrame:
    """Distinct vehicles per day and the change from the previous day in the data.

    The window has no partition key, but only sees one row per calendar day.
    """
    daily = df.groupBy(date_of().alias("date")).agg(F.count_distinct("vin_id").alias("active_vehicles"))
    before = F.lag("active_vehicles").over(Window.orderBy("date"))
    return daily.withColumn("difference", F.col("active_vehicles") - before)


kpi_avg_fuel = average("kpi_avg_fuel")
kpi_avg_speed = average("kpi_avg_speed")
kpi_avg_soc = average("kpi_avg_soc")
kpi_avg_charging = average("kpi_avg_charging")
by_vehicle_fuel = average("by_vehicle_fuel")
by_vehicle_speed = average("by_vehicle_speed")
by_vehicle_soc = average("by_vehicle_soc")
by_vehicle_charging = average("by_vehicle_charging")
by_vehicle_cltc_wltc = average("by_vehicle_cltc_wltc")
scatter_speed_fuel = average("scatter_speed_fuel")
table_vehicle_fuel_speed = average("table_vehicle_fuel_speed")
table_vehicle_fuel_speed_charging = average("table_vehicle_fuel_speed_charging")
table_vehicle_soc_speed_charging = average("table_vehicle_soc_speed_charging")
table_vehicle_soc_speed_charging_cltc = average("table_vehicle_soc_speed_charging_cltc")
trend_hourly_fuel_speed = average("trend_hourly_fuel_speed")
trend_hourly_fuel = average("trend_hourly_fuel")
trend_hourly_speed = average("trend_hourly_speed")
trend_hourly_soc = average("trend_hourly_soc")
trend_hourly_charging = average("trend_hourly_charging")

QUERIES: dict[str, Callable[[DataFrame], DataFrame]] = {
    **{key: average(key) for key in AVERAGES},
    "kpi_active_vehicles": kpi_active_vehicles,
    "gauge_avg_charging": gauge_avg_charging,
    "mode_distribution": mode_distribution,
    "kpi_active_vehicles_diff": kpi_active_vehicles_diff,
}
