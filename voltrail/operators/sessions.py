"""Charging sessions: runs of charging readings with no gap longer than a limit.

Two readings in the same slice of one gap length are always in the same session.
So readings first collapse to one row per vehicle and slice, with a partial step
before the shuffle. Slices of disjoint inputs merge by the same aggregate, which
the stream uses.

Sessions are a segmented prefix scan over the slices. Inside a block of at most
`BLOCK_SLICES` slices of a vehicle, runs of slices without a long silence are
numbered. A block sums up to its first and last reading, the openings inside it
and the latest one; a scan over these summaries, one row per block, says how many
sessions each block finds before it and which one is still open. Runs that go on
over a block's edge share a number. So a vehicle with many short slices spreads
over many tasks, and one join adds the summaries.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from voltrail.functions.signals import is_charging

GAP_SECONDS = 6 * 3600
BLOCK_SLICES = 65_536


def charging_slices(df: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    slice_no = F.floor(F.unix_micros("ts") / F.lit(gap_seconds * 1_000_000))
    return (
        df.where(is_charging() & F.col("ts").isNotNull())
        .groupBy("vin_id", slice_no.alias("slice_no"))
        .agg(
            F.min("ts").alias("first_ts"),
            F.max("ts").alias("last_ts"),
            F.count(F.lit(1)).alias("n"),
            F.min("charging_time_remain_minute").alias("least_minutes"),
            F.max("charging_time_remain_minute").alias("most_minutes"),
        )
    )


def merge_slices(slices: DataFrame) -> DataFrame:
    return slices.groupBy("vin_id", "slice_no").agg(
        F.min("first_ts").alias("first_ts"),
        F.max("last_ts").alias("last_ts"),
        F.sum("n").alias("n"),
        F.min("least_minutes").alias("least_minutes"),
        F.max("most_minutes").alias("most_minutes"),
    )


def sessions_from_slices(
    slices: DataFrame, gap_seconds: int = GAP_SECONDS, block_slices: int = BLOCK_SLICES
) -> DataFrame:
    """A slice opens a session when its first reading is more than one gap after the last one."""
    gap = F.lit(gap_seconds * 1_000_000)

    def silent(since: Column, until: Column) -> Column:
        return F.unix_micros(until) - F.unix_micros(since) > gap

    # A struct is never NULL, so vehicles without a number join like all others.
    block = F.struct("vin_id", F.floor(F.col("slice_no") / block_slices).alias("block_no"))
    inside = Window.partitionBy("__block").orderBy("slice_no")
    rows = slices.withColumn("__block", block).withColumn(
        "__opens", F.coalesce(silent(F.lag("last_ts").over(inside), F.col("first_ts")), F.lit(False)))
    run_no = F.sum(F.col("__opens").cast("long")).over(inside.rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("__run", run_no)
    # Openings rise with time, so the latest one is the largest; the first run may go on from before.
    summaries = rows.groupBy("__block").agg(
        F.min("first_ts").alias("first"),
        F.max("last_ts").alias("last"),
        F.max("__run").alias("openings"),
        F.max(F.when(F.col("__opens"), F.col("first_ts"))).alias("latest"),
    )
    in_order = Window.partitionBy("__block.vin_id").orderBy("__block.block_no")
    earlier = in_order.rowsBetween(Window.unboundedPreceding, -1)
    opened = F.coalesce(silent(F.lag("last").over(in_order), F.col("first")), F.lit(True))
    summaries = summaries.withColumn("opened", opened).withColumn(
        "latest", F.coalesce("latest", F.when(F.col("opened"), F.col("first"))))
    known = summaries.select(
        F.col("__block").alias("__of"),
        (F.coalesce(F.sum(F.col("openings") + F.col("opened").cast("long")).over(earlier), F.lit(0))
         + F.col("opened").cast("long")).alias("__before"),
        F.when(~F.col("opened"), F.max("latest").over(earlier)).alias("__carried"),
    )
    carried = F.when(F.col("__run") == 0, F.col("__carried"))
    return rows.join(known, F.col("__block") == F.col("__of")).groupBy(
        "vin_id", (F.col("__before") + F.col("__run")).alias("session_no")
    ).agg(
        F.min(F.coalesce(carried, "first_ts")).alias("session_start"),
        F.max("last_ts").alias("session_end"),
        F.sum("n").alias("reading_count"),
        (F.max("most_minutes") - F.min("least_minutes")).alias("minutes_drop"),
    )


def charging_sessions_true(df: DataFrame, gap_seconds: int = GAP_SECONDS) -> DataFrame:
    return sessions_from_slices(charging_slices(df, gap_seconds), gap_seconds)
