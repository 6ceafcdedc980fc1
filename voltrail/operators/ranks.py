"""First-of-group, numbering and quantiles that never gather a group in one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_RANK = "__rank"


def first_per_group(df: DataFrame, keys: Sequence[Column], order: Sequence[Column]) -> DataFrame:
    """The first row of each group.

    Spark plans `row_number() = 1` with a `WindowGroupLimit` before the shuffle,
    so each map task sends at most one row per group however large the group is.
    """
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return df.withColumn(_RANK, rank).where(F.col(_RANK) == 1).drop(_RANK)


def join_per_group(rows: DataFrame, groups: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Add the columns of `groups`, one row per key, to `rows`; NULL keys match each other."""
    other = groups.withColumnsRenamed({k: f"__of_{k}" for k in keys})
    matched = F.lit(True)
    for k in keys:
        matched = matched & F.col(k).eqNullSafe(F.col(f"__of_{k}"))
    return rows.join(other, matched, how).drop(*[f"__of_{k}" for k in keys])


def number_within(
    df: DataFrame, keys: Sequence[str], position: str, out: str, block_rows: int = 65_536
) -> DataFrame:
    """1-based number of each row within `keys`, ordered by the integer `position`.

    Rows are numbered inside blocks of `block_rows` positions, and each block
    starts after the rows of the earlier ones. With positions unique per group a
    block holds at most `block_rows` rows, so the largest group spreads over many
    tasks; the running total sees one row per block.
    """
    block = F.floor(F.col(position) / block_rows)
    rows = df.withColumn("__block", block)
    sizes = rows.groupBy(*keys, "__block").agg(F.count(F.lit(1)).alias("__size"))
    running = Window.partitionBy(*keys).orderBy("__block").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(*keys, "__block", F.coalesce(F.sum("__size").over(running), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(*keys, "__block").orderBy(position)
    number = F.row_number().over(inside) + F.col("__start")
    return join_per_group(rows, starts, [*keys, "__block"]).select(*df.columns, number.alias(out))


def value_block(value: Column, blocks_per_e: int = 1024) -> Column:
    """Ascending block numbers that are as fine as the values are close.

    A block spans about a thousandth of its values' size, which is some thousand distinct numbers of 24 binary places,
    whatever the range; only sizes below a millionth share blocks. NaN goes with the largest, as it sorts.
    """
    scaled = F.signum(value) * F.log1p(F.abs(value) * 1000) * blocks_per_e
    return F.when(F.isnan(value), F.lit(2**63 - 1)).otherwise(F.floor(scaled))


def ranked_values(df: DataFrame, key: str, value: str) -> DataFrame:
    """(key, `value`, `n`, `upto`, `total`): each distinct value of a key, how often it
    occurs, how many values of the key are not greater, and how many there are.

    The rows collapse to distinct values with a partial step before the shuffle.
    Counts per block of values say where each block starts, so ranks are
    found block by block and no task needs all values of a key. NULLs stay as one
    value that occurs 0 times, so that every key is present. NaN counts as the
    largest value and the two zeros as one, as Spark's own percentiles have it.
    """
    number = F.col(value).cast("double")
    counted = (
        df.groupBy(F.col(key), number.alias("value"))
        .agg(F.count(value).alias("n"))
        .withColumn("__slot", F.struct(F.col(key), value_block(F.col("value")).alias("block")))
    )
    blocks = counted.groupBy("__slot").agg(F.sum("n").alias("__block_n"))
    whole = Window.partitionBy(f"__slot.{key}")
    earlier = whole.orderBy("__slot.block").rowsBetween(Window.unboundedPreceding, -1)
    starts = blocks.select(
        "__slot",
        F.coalesce(F.sum("__block_n").over(earlier), F.lit(0)).alias("__start"),
        F.sum("__block_n").over(whole).alias("total"),
    )
    inside = Window.partitionBy("__slot").orderBy("value")
    return counted.join(starts, "__slot").select(
        key, "value", "n", (F.sum("n").over(inside) + F.col("__start")).alias("upto"), "total"
    )


def quantile_of_ranked(q: float) -> Column:
    """The interpolated quantile, as an aggregate over the `ranked_values` of a key."""
    where = (F.col("total") - 1) * F.lit(float(q))

    def at(rank: Column) -> Column:
        """The value that covers the 0-based rank."""
        covers = (F.col("upto") - F.col("n") <= rank) & (rank < F.col("upto"))
        return F.max(F.when(covers, F.col("value")))

    low, high = at(F.floor(where)), at(F.ceil(where))
    return low + (high - low) * F.max(where - F.floor(where))
