"""Typed projections for business-intelligence tools."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.schema import BI_COLUMNS_7, BI_COLUMNS_9, READINGS_COLUMNS, READINGS_SCHEMA

# BI type names STRING, INTEGER, BIT, DECIMAL, DATETIME in Spark; the decimal's scale is our choice.
_BI_TYPES = {"float": "decimal(10,2)"}


def bi_dataset(df: DataFrame, columns: Sequence[str] = READINGS_COLUMNS) -> DataFrame:
    """The named columns cast to their BI types; others are never read."""
    kinds = {f.name: f.dataType.simpleString() for f in READINGS_SCHEMA}
    return df.select(*[F.col(c).cast(_BI_TYPES.get(kinds[c], kinds[c])).alias(c) for c in columns])


def bi_dataset_9col(df: DataFrame) -> DataFrame:
    return bi_dataset(df, BI_COLUMNS_9)


def bi_dataset_7col(df: DataFrame) -> DataFrame:
    return bi_dataset(df, BI_COLUMNS_7)
