"""Vehicle status, alerts, shares, efficiency, health and anomalies."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions.signals import date_of, low_power_count
from voltrail.operators.filters import low_battery_alerts
from voltrail.operators.ranks import first_per_group, join_per_group, quantile_of_ranked, ranked_values


def vehicle_latest_status(df: DataFrame) -> DataFrame:
    """The newest reading per vehicle; equal instants are settled by the other columns.

    The newest instants are a hash aggregate over two columns. Only the readings
    of those instants, which meet them by a join, are ever sorted by all columns.
    """
    newest = df.groupBy("vin_id").agg(F.max("ts").alias("__newest"))
    at_newest = join_per_group(df, newest, ["vin_id"]).where(F.col("ts").eqNullSafe(F.col("__newest"))).drop("__newest")
    rest = [F.col(f"`{c}`") for c in df.columns if c not in ("vin_id", "ts")]
    return first_per_group(at_newest, [F.col("vin_id")], rest)


def fuel_level_bands(df: DataFrame, width: int = 20, top: int = 80) -> DataFrame:
    """Readings per fuel band; the last band starts at `top` and includes a full tank."""
    low = F.least((F.floor(F.col("fuel_percentage") / width) * width).cast("int"), F.lit(top))
    band = F.when(F.col("fuel_percentage").isNotNull(), low)
    return df.groupBy(band.alias("band_low")).agg(F.count(F.lit(1)).alias("reading_count"))


def speed_profile(df: DataFrame) -> DataFrame:
    """Exact min, mean, median, 95th percentile and maximum speed per vehicle."""
    speeds = ranked_values(df, "vin_id", "display_speed")
    return speeds.groupBy("vin_id").agg(
        F.min("value").cast("float").alias("min_speed"),
        F.try_divide(F.sum(F.col("value") * F.col("n")), F.sum("n")).alias("avg_speed"),
        F.max("value").cast("float").alias("max_speed"),
        quantile_of_ranked(0.5).alias("p50_speed"),
        quantile_of_ranked(0.95).alias("p95_speed"),
    )


def speed_profile_approx(df: DataFrame, accuracy: int = 10_000) -> DataFrame:
    """One-pass variant whose percentiles carry a relative rank error of `1 / accuracy`."""
    return df.groupBy("vin_id").agg(
        F.min("display_speed").alias("min_speed"),
        F.avg("display_speed").alias("avg_speed"),
        F.max("display_speed").alias("max_speed"),
        F.percentile_approx("display_speed", 0.5, accuracy).alias("p50_speed"),
        F.percentile_approx("display_speed", 0.95, accuracy).alias("p95_speed"),
    )


def driving_behavior_share(df: DataFrame) -> DataFrame:
    """Share of each (clean, road) mode in a vehicle's readings.

    The window runs over the aggregate: one row per vehicle and mode pair.
    """
    modes = df.groupBy("vin_id", "clean_mode", "road_mode").agg(F.count(F.lit(1)).alias("mode_count"))
    total = F.sum("mode_count").over(Window.partitionBy("vin_id"))
    return modes.withColumn("share", F.col("mode_count") / total)


def energy_efficiency(df: DataFrame) -> DataFrame:
    """Range ratio of the two test cycles, and mean fuel spread within a day, per vehicle."""
    daily = df.groupBy("vin_id", date_of().alias("date")).agg(
        F.sum("fuel_cltc_mileage").alias("cltc_sum"),
        F.count("fuel_cltc_mileage").alias("cltc_n"),
        F.sum("fuel_wltc_mileage").alias("wltc_sum"),
        F.count("fuel_wltc_mileage").alias("wltc_n"),
        (F.max("fuel_percentage") - F.min("fuel_percentage")).alias("fuel_used"),
    )
    wltc = F.try_divide(F.sum("wltc_sum").cast("double"), F.sum("wltc_n"))
    cltc = F.try_divide(F.sum("cltc_sum").cast("double"), F.sum("cltc_n"))
    return daily.groupBy("vin_id").agg(
        F.try_divide(wltc, cltc).alias("wltc_cltc_ratio"),
        F.avg("fuel_used").alias("avg_daily_fuel_used"),
    )


def speed_anomalies(df: DataFrame, deviations: float = 3.0) -> DataFrame:
    """Readings further than `deviations` sample standard deviations from the vehicle's mean.

    A window per vehicle would hold all its readings in one task. Here the mean
    and deviation come from a partial aggregate, and the readings join the one
    row per vehicle: a broadcast when that side is measured to be small, else a
    shuffle whose oversized partitions AQE splits.
    """
    stats = df.groupBy("vin_id").agg(
        F.avg("display_speed").alias("mean_speed"),
        F.stddev_samp("display_speed").alias("stddev_speed"),
    )
    distance = F.abs(F.col("display_speed") - F.col("mean_speed"))
    return join_per_group(df, stats, ["vin_id"]).where(distance > deviations * F.col("stddev_speed"))


def battery_health(df: DataFrame) -> DataFrame:
    return df.groupBy("vin_id").agg(
        F.avg("target_soc").alias("avg_soc"),
        F.stddev_samp("target_soc").alias("stddev_soc"),
        F.min("target_soc").alias("min_soc"),
        F.avg(low_power_count()).alias("low_flag_rate"),
    )


def alert_counts_by_day(df: DataFrame, soc_below: int = 20) -> DataFrame:
    return low_battery_alerts(df, soc_below).groupBy("vin_id", date_of().alias("date")).agg(
        F.count(F.lit(1)).alias("alert_count")
    )
