"""Rows for tests: every column has a default, so a test names only what it is about."""

from datetime import datetime, timedelta, timezone

from pyspark.sql import functions as F

from voltrail.operators.cleaning import add_primary_key, conform
from voltrail.schema import READINGS_SCHEMA

T0 = datetime(2024, 1, 1, tzinfo=timezone.utc)

DEFAULTS = {
    "__primary_key": None, "vin_id": "A", "charging_time_remain_minute": 0, "extender_starting_point": 0,
    "fuel_cltc_mileage": 400, "fuel_wltc_mileage": 380, "fuel_percentage": 50, "clean_mode": 0, "road_mode": 0,
    "ress_power_low_flag": False, "target_soc": 80, "display_speed": 10.0, "channel_id": 1, "endurance_type": 1,
    "ts": T0,
}


def at(hours=0.0, **more):
    return T0 + timedelta(hours=hours, **more)


def make_readings(spark, *rows):
    full = [tuple({**DEFAULTS, **row}[c] for c in READINGS_SCHEMA.names) for row in rows]
    return conform(add_primary_key(spark.createDataFrame(full, READINGS_SCHEMA)))


def as_dicts(df, *order):
    rows = [r.asDict(recursive=True) for r in df.collect()]
    return sorted(rows, key=lambda r: tuple(str(r[c]) for c in order)) if order else rows


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


def same_rows(a, b):
    """Equal as multisets, whatever the column order."""
    columns = sorted(a.columns)
    assert columns == sorted(b.columns)
    rows = [sorted(tuple(str(v) for v in r) for r in df.select(*columns).collect()) for df in (a, b)]
    return rows[0] == rows[1]


def utc(df, column):
    """Instants as text, free of the Python process's time zone."""
    return df.withColumn(column, F.date_format(column, "yyyy-MM-dd HH:mm:ss"))
