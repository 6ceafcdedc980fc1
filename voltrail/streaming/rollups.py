"""Rollups, trends and sessions kept up to date from a stream of readings.

Sums, minima, maxima and counts of disjoint inputs can be merged, so each
micro-batch only adds its own partial result and a query merges them. A reading
that arrives weeks late is just another row to merge: there is no watermark
behind which rows would be dropped, and no state that grows with the fleet.
"""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltrail.operators.measures import FUEL, SPEED
from voltrail.operators.ranks import first_per_group
from voltrail.operators.rollups import daily_summary_from_facts, day_mode_facts, merge_facts
from voltrail.operators.sessions import GAP_SECONDS, charging_slices, merge_slices, sessions_from_slices
from voltrail.operators.trends import hourly_sums, sliding_from_hourly
from voltrail.schema import READINGS_SCHEMA
from voltrail.streaming.incremental import compact_batches, read_batches, start_batches


def _no_readings(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], READINGS_SCHEMA)


def _facts_shape(spark: SparkSession) -> DataFrame:
    return day_mode_facts(_no_readings(spark))


def _slices_shape(spark: SparkSession) -> DataFrame:
    return charging_slices(_no_readings(spark))


def _hours_shape(spark: SparkSession) -> DataFrame:
    return hourly_sums(_no_readings(spark))


def stream_daily_summary(stream: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    return start_batches(stream, out, checkpoint, day_mode_facts, **options)


def daily_summary_so_far(spark: SparkSession, out: str) -> DataFrame:
    return daily_summary_from_facts(read_batches(_facts_shape(spark), out).drop("batch_id"))


def compact_daily_summary(spark: SparkSession, out: str) -> int | None:
    return compact_batches(_facts_shape(spark), out, lambda facts: merge_facts(facts.drop("batch_id")))


def stream_charging_sessions(
    stream: DataFrame, out: str, checkpoint: str, gap_seconds: int = GAP_SECONDS, **options
) -> StreamingQuery:
    return start_batches(stream, out, checkpoint, partial(charging_slices, gap_seconds=gap_seconds), **options)


def charging_sessions_so_far(spark: SparkSession, out: str, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    """`gap_seconds` must be the stream's."""
    return sessions_from_slices(merge_slices(read_batches(_slices_shape(spark), out)), gap_seconds)


def compact_charging_sessions(spark: SparkSession, out: str) -> int | None:
    return compact_batches(_slices_shape(spark), out, merge_slices)


def stream_hourly_trend(stream: DataFrame, out: str, checkpoint: str, **options) -> StreamingQuery:
    """A stateful hourly aggregate in update mode: each batch writes the hours it changed.

    The state holds one row per clock hour of the data, whatever its volume, so
    it needs no watermark and late readings still count.
    """
    return start_batches(hourly_sums(stream), out, checkpoint, mode="update", **options)


def _newest_hours(versions: DataFrame) -> DataFrame:
    return first_per_group(versions, [F.col("hour")], [F.col("batch_id").desc()])


def hourly_sums_so_far(spark: SparkSession, out: str) -> DataFrame:
    """The newest version of every hour."""
    return _newest_hours(read_batches(_hours_shape(spark), out)).drop("batch_id")


def hourly_trend_so_far(spark: SparkSession, out: str) -> DataFrame:
    return hourly_sums_so_far(spark, out).select(
        "hour",
        F.try_divide(f"{FUEL}_sum", f"{FUEL}_n").alias(f"avg_{FUEL}"),
        F.try_divide(f"{SPEED}_sum", f"{SPEED}_n").alias(f"avg_{SPEED}"),
    )


def sliding_trend_so_far(spark: SparkSession, out: str, hours: int = 24) -> DataFrame:
    """24-hour windows that start every hour, derived from the hourly stream's output."""
    return sliding_from_hourly(hourly_sums_so_far(spark, out), hours)


def compact_hourly_trend(spark: SparkSession, out: str) -> int | None:
    return compact_batches(_hours_shape(spark), out, _newest_hours)
