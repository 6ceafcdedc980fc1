"""Numbers of rows in order, for groups of any size."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltrail.session import fan_out, written


def same(left: Sequence[str], right: Sequence[str]) -> Column:
    """Equal columns, where null equals null."""
    matched = F.lit(True)
    for a, b in zip(left, right):
        matched = matched & F.col(a).eqNullSafe(F.col(b))
    return matched


def numbered(rows: DataFrame, group: Sequence[str], order: Sequence[str], label: str) -> DataFrame:
    """The rows with `nr`, from 0 on within `group` by `order` (null first), and the group's `total`.

    The rows are dealt by ranges of group and order, so a group that holds most rows spreads over many tasks, and so do
    rows that are equal in both. A row's place in its range is written with it; how many rows of its group stand in
    earlier ranges comes from one count per group and range.
    """
    by = [F.col(c).asc_nulls_first() for c in (*group, *order)]
    dealt = rows.withColumn("_tie", F.monotonically_increasing_id()).repartitionByRange(
        fan_out(rows.sparkSession), *by, F.col("_tie")).sortWithinPartitions(*by, "_tie").drop("_tie")
    placed = written(dealt.withColumn("_at", F.monotonically_increasing_id()), label)
    # The upper bits of the id are the range, the lower ones the place in it.
    placed = placed.withColumn("_range", F.shiftright("_at", 33))
    whole = Window.partitionBy(*group)
    earlier = whole.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    counts = placed.groupBy(*group, "_range").agg(F.min("_at").alias("_first"), F.count(F.lit(1)).alias("_n"))
    starts = counts.select(
        *[F.col(c).alias(f"_of_{c}") for c in group], F.col("_range").alias("_of_range"), "_first",
        F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_start"), F.sum("_n").over(whole).alias("total"))
    matched = (F.col("_range") == F.col("_of_range")) & same(group, [f"_of_{c}" for c in group])
    return placed.join(starts, matched).select(
        *rows.columns, (F.col("_at") - F.col("_first") + F.col("_start")).alias("nr"), "total")
