"""Time trends and multi-level summaries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions.signals import date_of, hour_of
from voltrail.operators.measures import FUEL, SOC, SPEED, trend_hourly_fuel_speed


def trend_moving_average(df: DataFrame, hours: int = 24) -> DataFrame:
    """Trailing mean over the last `hours` rows of the hourly trend.

    The window has no partition key, but only sees one row per clock hour.
    """
    trailing = Window.orderBy("hour").rowsBetween(1 - hours, 0)
    return trend_hourly_fuel_speed(df).select(
        "hour",
        F.avg(f"avg_{FUEL}").over(trailing).alias("fuel_moving_avg"),
        F.avg(f"avg_{SPEED}").over(trailing).alias("speed_moving_avg"),
    )


def trend_last_24h(df: DataFrame, hours: int = 24) -> DataFrame:
    """The hourly trend over the last `hours` before the newest reading.

    The newest instant is a scalar subquery: Spark runs it first, and the result
    reaches the scan as a literal. On a day-partitioned table it is looked up in the
    newest partition only, and the trend reads no earlier partition than it needs.
    """
    by_day = "ts_day" in df.columns
    latest = df.where(F.col("ts_day") == df.agg(F.max("ts_day")).scalar()) if by_day else df
    start = latest.agg(F.max("ts")).scalar() - F.expr(f"INTERVAL {int(hours)} HOURS")
    recent = df.where(F.col("ts") > start)
    if by_day:
        recent = recent.where(F.col("ts_day") >= F.to_date(start))
    return trend_hourly_fuel_speed(recent)


def _sums(df: DataFrame, keys: Sequence[Column | str], columns: Sequence[str]) -> DataFrame:
    """Row count, sum and count per column at one grain, ready to be added up."""
    parts = [F.count(F.lit(1)).alias("n")]
    for c in columns:
        parts += [F.sum(F.col(c).cast("double")).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]
    return df.groupBy(*keys).agg(*parts)


def _totals(columns: Sequence[str]) -> list[Column]:
    return [F.sum("n").alias("record_count")] + [
        F.try_divide(F.sum(f"{c}_sum"), F.sum(f"{c}_n")).alias(f"avg_{c}") for c in columns
    ]


def drill_down(df: DataFrame) -> DataFrame:
    """Fleet -> date -> vehicle -> hour totals with `grouping_id`.

    `rollup` copies each input row once per level, so it gets the hourly sums
    instead of the readings.
    """
    measures = [FUEL, SPEED]
    hourly = _sums(df, [date_of().alias("date"), "vin_id", hour_of().alias("hour")], measures)
    return hourly.rollup("date", "vin_id", "hour").agg(
        F.grouping_id().cast("int").alias("level_id"), *_totals(measures)
    )


def multi_dim_performance(df: DataFrame) -> DataFrame:
    """All combinations of the three mode columns, from one aggregate at the finest grain."""
    dims = ["clean_mode", "road_mode", "endurance_type"]
    measures = [SPEED, FUEL, SOC]
    return _sums(df, dims, measures).cube(*dims).agg(
        F.grouping_id().cast("int").alias("level_id"), *_totals(measures)
    )


def sliding_from_hourly(hourly: DataFrame, hours: int = 24) -> DataFrame:
    """Every window of `hours` hours that starts on the hour, from sums per hour.

    Adding hourly sums copies one row per hour `hours` times; a sliding window
    over the readings would copy every reading.
    """
    back = F.sequence(
        F.col("hour") - F.expr(f"INTERVAL {int(hours) - 1} HOURS"), F.col("hour"), F.expr("INTERVAL 1 HOUR")
    )
    starts = hourly.where(F.col("hour").isNotNull()).withColumn("window_start", F.explode(back))
    return starts.groupBy("window_start").agg(*_totals([FUEL, SPEED]))


def hourly_sums(df: DataFrame) -> DataFrame:
    return _sums(df, [hour_of().alias("hour")], [FUEL, SPEED])
