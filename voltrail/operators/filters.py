"""Row filters that keep partition pruning and avoid needless shuffles."""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.functions.signals import is_low_battery


def filter_time_range(
    df: DataFrame, start: datetime | str, end: datetime | str, ts: str = "ts", day: str = "ts_day"
) -> DataFrame:
    """`start <= ts < end`, with day bounds so that a day-partitioned table prunes."""
    low, high = F.lit(start).cast("timestamp"), F.lit(end).cast("timestamp")
    kept = df.where((F.col(ts) >= low) & (F.col(ts) < high))
    if day in df.columns:
        kept = kept.where(F.col(day).between(F.to_date(low), F.to_date(high)))
    return kept


def filter_vehicles(df: DataFrame, ids: Sequence[str] | DataFrame, vin: str = "vin_id") -> DataFrame:
    """Rows of the chosen vehicles: a semi join, whose strategy is left to Catalyst; AQE splits hot vehicles."""
    if not isinstance(ids, DataFrame):
        ids = df.sparkSession.createDataFrame([(v,) for v in sorted(set(ids))], f"{vin} string")
    return df.join(ids.select(F.col(ids.columns[0]).alias(vin)), vin, "left_semi")


def low_battery_alerts(df: DataFrame, soc_below: int = 20) -> DataFrame:
    return df.where(is_low_battery(soc_below))
