"""Daily sketches that merge over any range of days: distinct vehicles and quantiles, without a look at the readings.

A sketch has a bounded size, whatever the readings of its day. Days are merged by one hash aggregate over sketches, so a
range costs as much as it has days and vehicles. Sketches of a day that got more readings are made anew by day, like any
other rollup, and equal sketches of different tables merge.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.functions.signals import date_of
from voltrail.operators.measures import SPEED

# 2 ** 14 registers: a standard error of 0.8 percent, in at most 16 KB.
VEHICLE_BITS = 14
# 200 places: ranks within about 1.65 percent (at 99 percent confidence), in a few KB.
QUANTILE_PLACES = 200


def daily_vehicle_sketches(df: DataFrame, bits: int = VEHICLE_BITS) -> DataFrame:
    """(date, vehicles): the distinct vehicles of each day as a sketch.

    Vehicles first collapse to one row per day, so a hot vehicle is one update.
    """
    seen = df.where(F.col("vin_id").isNotNull()).select(date_of().alias("date"), "vin_id").distinct()
    return seen.groupBy("date").agg(F.hll_sketch_agg("vin_id", bits).alias("vehicles"))


def active_vehicles_by_range(sketches: DataFrame, days: int = 7) -> DataFrame:
    """(date, active_vehicles): about how many vehicles reported in the `days` days that end with each day that has data.

    A day's sketch goes to the ranges that hold it; no range needs more than `days` sketches. Readings without a time
    have no day and are in no range.
    """
    held = sketches.where(F.col("date").isNotNull())
    spread = held.withColumn("end", F.explode(F.sequence("date", F.date_add("date", days - 1))))
    merged = spread.groupBy(F.col("end").alias("date")).agg(F.hll_union_agg("vehicles").alias("vehicles"))
    return merged.join(held.select("date"), "date", "left_semi").select(
        "date", F.hll_sketch_estimate("vehicles").alias("active_vehicles"))


def daily_speed_sketches(df: DataFrame, places: int = QUANTILE_PLACES) -> DataFrame:
    """(vin_id, date, speeds, min_speed, max_speed, sum_speed, n): each vehicle's speeds of a day.

    NULL and NaN speeds are in no sketch, as they have no rank; `n` counts the others.
    """
    speed = F.when(~F.isnan(SPEED), F.col(SPEED))
    return df.groupBy("vin_id", date_of().alias("date")).agg(
        F.kll_sketch_agg_double(speed.cast("double"), places).alias("speeds"),
        F.min(speed).alias("min_speed"), F.max(speed).alias("max_speed"),
        F.sum(speed.cast("double")).alias("sum_speed"), F.count(speed).alias("n"))


def speed_profile_of_days(sketches: DataFrame, start: str | None = None, end: str | None = None) -> DataFrame:
    """The speed profile from daily sketches, of the days from `start` up to before `end` (all by default).

    Minimum, mean and maximum are exact; the two percentiles are speeds whose rank is about right.
    """
    days = sketches
    if start is not None:
        days = days.where(F.col("date") >= F.lit(start).cast("date"))
    if end is not None:
        days = days.where(F.col("date") < F.lit(end).cast("date"))
    merged = days.groupBy("vin_id").agg(
        F.kll_merge_agg_double("speeds").alias("speeds"), F.min("min_speed").alias("min_speed"),
        F.try_divide(F.sum("sum_speed"), F.sum("n")).alias("avg_speed"), F.max("max_speed").alias("max_speed"),
        F.sum("n").alias("n"))

    def at(q: float):
        # A sketch of nothing has no quantile.
        return F.when(F.col("n") > 0, F.kll_sketch_get_quantile_double("speeds", F.lit(q)))

    return merged.select(
        "vin_id", "min_speed", "avg_speed", "max_speed", at(0.5).alias("p50_speed"), at(0.95).alias("p95_speed"))
