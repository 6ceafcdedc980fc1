"""Idempotent appends and last-writer-wins."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.functions.keys import basename
from voltrail.operators.ranks import first_per_group

IDENTITY = "__identity"


def whole_row(df: DataFrame) -> Column:
    return F.to_json(F.struct(*[F.col(f"`{c}`") for c in df.columns]))


def row_identity(df: DataFrame, key: str = "__primary_key") -> Column:
    """The key, or the whole row as JSON where the key is NULL.

    Rows without a key are not copies of one another unless they agree in every column.
    """
    return F.coalesce(F.col(key), whole_row(df))


def one_per_identity(df: DataFrame, key: str = "__primary_key") -> DataFrame:
    """One row per identity, which stays as a column: later steps on it need no shuffle of their own."""
    order = [F.col(f"`{c}`") for c in df.columns if c != key]
    return first_per_group(df.withColumn(IDENTITY, row_identity(df, key)), [F.col(IDENTITY)], order)


def dedup_readings(df: DataFrame, key: str = "__primary_key") -> DataFrame:
    """One row per key; among differing rows the smallest by the other columns stays."""
    return one_per_identity(df, key).drop(IDENTITY)


def new_readings(incoming: DataFrame, existing: DataFrame, key: str = "__primary_key") -> DataFrame:
    """Incoming rows, each once, whose key is not in `existing` yet.

    The scan for existing keys reads the key column only. Rows without a key are
    looked up in a scan of their own, which skips files that have none. Copies in
    the table collapse before the shuffle, and both sides meet on one shuffle each.
    """
    existing = existing.select(*incoming.columns)
    seen = existing.where(F.col(key).isNotNull()).select(F.col(key).alias(IDENTITY)).union(
        existing.where(F.col(key).isNull()).select(whole_row(existing).alias(IDENTITY))
    )
    return one_per_identity(incoming, key).join(seen.distinct(), IDENTITY, "left_anti").drop(IDENTITY)


def flatten_last_writer_wins(
    df: DataFrame, path: str, order: Sequence[str], target_prefix: str = "processed/"
) -> DataFrame:
    """One row per basename: the last by `order`, then by path, under `processed/<basename>`."""
    named = df.withColumn("target", F.concat(F.lit(target_prefix), basename(F.col(path))))
    latest = [F.col(c).desc_nulls_last() for c in [*order, path]]
    return first_per_group(named, [F.col("target")], latest)


def basename_collisions(df: DataFrame, path: str) -> DataFrame:
    """Basenames that more than one path maps to, with the number of paths."""
    return (
        df.groupBy(basename(F.col(path)).alias("basename"))
        .agg(F.count_distinct(path).alias("paths"))
        .where("paths > 1")
    )
