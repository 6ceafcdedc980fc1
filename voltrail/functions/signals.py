"""Column expressions over telemetry signals."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def primary_key(vin: str = "vin_id", ts: str = "ts") -> Column:
    """`vin_ts`; NULL when either part is NULL, which `concat_ws` would hide."""
    return F.concat(F.col(vin), F.lit("_"), F.col(ts).cast("string"))


def epoch_key(vin: str = "vin_id", ts: str = "ts") -> Column:
    """The sample rows' key form: `vin_epochseconds`."""
    return F.concat(F.col(vin), F.lit("_"), F.unix_timestamp(F.col(ts)).cast("string"))


def date_of(ts: str = "ts") -> Column:
    return F.to_date(F.col(ts))


def hour_of(ts: str = "ts") -> Column:
    return F.date_trunc("hour", F.col(ts))


def is_charging(minutes: str = "charging_time_remain_minute") -> Column:
    return F.col(minutes) > 0


def low_power_count(flag: str = "ress_power_low_flag") -> Column:
    """1 for a raised flag, 0 for a clear or unknown one."""
    return F.when(F.col(flag), 1).otherwise(0)


def is_low_battery(soc_below: int, flag: str = "ress_power_low_flag", soc: str = "target_soc") -> Column:
    return F.coalesce(F.col(flag), F.lit(False)) | F.coalesce(F.col(soc) < soc_below, F.lit(False))
