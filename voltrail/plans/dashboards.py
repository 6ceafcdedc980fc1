"""The ten dashboards and their 65 visuals.

Each visual is one of the queries in `voltrail.operators.measures`. A dashboard
asked visual by visual scans the readings once per visual; `visual_facts` scans
them once for all, with a grouping set per dimension that the dashboard shows and
the sums of its own measures. The facts have a row per vehicle, hour and mode, not
one per combination of them.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.functions.signals import hour_of
from voltrail.operators.filters import filter_time_range
from voltrail.operators.measures import AVERAGES, CHARGING, QUERIES

# grouping_id() of the set that keeps one of (vin_id, hour, clean_mode), or none.
_DIMS = {"vin_id": 0b011, "hour": 0b101, "clean_mode": 0b110, None: 0b111}

# Dashboard -> visual id -> query.
DASHBOARDS: dict[str, dict[str, str]] = {
    "complete": {
        "active_vehicles_kpi": "kpi_active_vehicles",
        "avg_fuel_kpi": "kpi_avg_fuel",
        "avg_speed_kpi": "kpi_avg_speed",
        "trend_line_chart": "trend_hourly_fuel_speed",
        "mileage_bar_chart": "by_vehicle_cltc_wltc",
        "driving_mode_pie": "mode_distribution",
        "vehicle_status_table": "table_vehicle_fuel_speed_charging",
    },
    "compact": {
        "active_vehicles_kpi": "kpi_active_vehicles",
        "vehicle_table": "table_vehicle_fuel_speed",
    },
    # Its vehicle figure is compared with the day before.
    "filtered": {
        "active_vehicles_kpi": "kpi_active_vehicles_diff",
        "avg_fuel_kpi": "kpi_avg_fuel",
        "trend_line_chart": "trend_hourly_fuel_speed",
        "driving_mode_pie": "mode_distribution",
    },
    "automatic": {
        "kpi_vehicles": "kpi_active_vehicles",
        "kpi_fuel": "kpi_avg_fuel",
        "table_vehicles": "table_vehicle_fuel_speed",
    },
    "fixed": {
        "kpi_vehicles": "kpi_active_vehicles",
        "kpi_fuel": "kpi_avg_fuel",
        "kpi_speed": "kpi_avg_speed",
        "table_vehicles": "table_vehicle_fuel_speed",
        "bar_fuel_distribution": "by_vehicle_fuel",
    },
    "styled": {
        "kpi_vehicles": "kpi_active_vehicles",
        "kpi_fuel": "kpi_avg_fuel",
        "kpi_speed": "kpi_avg_speed",
        "line_trend": "trend_hourly_fuel_speed",
        "pie_modes": "mode_distribution",
        "scatter_speed_fuel": "scatter_speed_fuel",
        "bar_fuel_comparison": "by_vehicle_fuel",
        "gauge_charging": "gauge_avg_charging",
        "table_details": "table_vehicle_fuel_speed_charging",
    },
    "styled_simple": {
        "kpi_vehicles": "kpi_active_vehicles",
        "kpi_fuel": "kpi_avg_fuel",
        "kpi_speed": "kpi_avg_speed",
        "line_trend": "trend_hourly_fuel",
        "bar_fuel_comparison": "by_vehicle_fuel",
        "line_speed_trend": "trend_hourly_speed",
        "bar_speed_comparison": "by_vehicle_speed",
        "table_details": "table_vehicle_fuel_speed_charging",
    },
    "electric": {
        "kpi_ev_count": "kpi_active_vehicles",
        "kpi_soc": "kpi_avg_soc",
        "kpi_ev_speed": "kpi_avg_speed",
        "kpi_charging_time": "kpi_avg_charging",
        "line_soc_trend": "trend_hourly_soc",
        "line_charging_trend": "trend_hourly_charging",
        "bar_soc_comparison": "by_vehicle_soc",
        "bar_charging_comparison": "by_vehicle_charging",
        "table_ev_details": "table_vehicle_soc_speed_charging",
    },
    "electric_realistic": {
        "kpi_ev_count": "kpi_active_vehicles",
        "kpi_battery_level": "kpi_avg_fuel",
        "kpi_ev_speed": "kpi_avg_speed",
        "kpi_charging_time": "kpi_avg_charging",
        "line_battery_trend": "trend_hourly_fuel",
        "line_charging_trend": "trend_hourly_charging",
        "bar_battery_comparison": "by_vehicle_fuel",
        "bar_speed_comparison": "by_vehicle_speed",
        "table_ev_details": "table_vehicle_fuel_speed_charging",
    },
    "electric_business": {
        "kpi_ev_fleet_size": "kpi_active_vehicles",
        "kpi_avg_soc": "kpi_avg_soc",
        "kpi_avg_charging_time": "kpi_avg_charging",
        "kpi_avg_speed": "kpi_avg_speed",
        "line_soc_trend": "trend_hourly_soc",
        "line_charging_trend": "trend_hourly_charging",
        "bar_soc_by_vehicle": "by_vehicle_soc",
        "bar_mileage_comparison": "by_vehicle_cltc_wltc",
        "table_ev_business_details": "table_vehicle_soc_speed_charging_cltc",
    },
}


def _dim(key: str) -> str | None:
    """The dimension whose rows answer query `key`; vehicles are counted from their own rows."""
    if key in AVERAGES:
        return AVERAGES[key][0]
    return {"kpi_active_vehicles": "vin_id", "mode_distribution": "clean_mode"}.get(key)


def visual_facts(df: DataFrame, name: str) -> DataFrame:
    """A row per value of each dimension in the dashboard, and one over all: sums and counts of its measures."""
    keys = [k for k in DASHBOARDS[name].values() if k != "kpi_active_vehicles_diff"]
    sets = [[d] if d else [] for d in _DIMS if d is None or any(_dim(k) == d for k in keys)]
    measures = sorted({c for k in keys if k in AVERAGES for c in AVERAGES[k][1]} | {CHARGING})
    parts = [F.count("vin_id").alias("n"), F.min(CHARGING).alias("charging_min"), F.max(CHARGING).alias("charging_max")]
    for c in measures:
        parts += [F.sum(F.col(c).cast("double")).alias(f"{c}_sum"), F.count(c).alias(f"{c}_n")]
    rows = df.select("vin_id", hour_of().alias("hour"), "clean_mode", *measures)
    return rows.groupingSets(sets, "vin_id", "hour", "clean_mode").agg(F.grouping_id().alias("set"), *parts)


def _mean(column: str) -> Column:
    return F.try_divide(F.col(f"{column}_sum"), F.col(f"{column}_n"))


def _values(key: str, total: Column) -> list[tuple[str, Column]]:
    """The measures of query `key` on a row of its dimension."""
    if key in AVERAGES:
        return [(f"avg_{c}", _mean(c)) for c in AVERAGES[key][1]]
    if key == "gauge_avg_charging":
        ends = [(f"{how}_{CHARGING}", F.col(f"charging_{how}")) for how in ("min", "max")]
        return [(f"avg_{CHARGING}", _mean(CHARGING)), *ends]
    if key == "mode_distribution":
        return [("vehicle_records", F.col("n")), ("share", F.try_divide(F.col("n"), total))]
    if key == "kpi_active_vehicles":
        return [("active_vehicles", F.when(F.col("vin_id").isNotNull(), 1).otherwise(0))]
    raise KeyError(key)


def dashboard(
    df: DataFrame, name: str, start: datetime | str | None = None, end: datetime | str | None = None
) -> DataFrame:
    """All visuals in one table: (visual_id, dimension, measure, value), for readings from `start` until before `end`.

    One scan answers all averages, gauges and counts. The vehicle count adds up the vehicles' rows; the share of a mode
    needs the number of readings, a count over one column, and the change from day to day a count per day.
    """
    if start is not None or end is not None:
        df = filter_time_range(df, start or "0001-01-01", end or "9999-12-31")
    visuals = DASHBOARDS[name]
    total = df.agg(F.count("vin_id")).scalar() if "mode_distribution" in visuals.values() else F.lit(None)
    none = F.array().cast("array<struct<visual_id:string,dimension:string,measure:string,value:double>>")

    def entry(visual: str, dimension: Column, measure: str, value: Column) -> Column:
        return F.struct(
            F.lit(visual).alias("visual_id"), dimension.alias("dimension"), F.lit(measure).alias("measure"),
            value.cast("double").alias("value"))

    entries = []
    for visual, key in visuals.items():
        if key == "kpi_active_vehicles_diff":
            continue
        dim = _dim(key)
        shown = F.col(dim).cast("string") if dim and key != "kpi_active_vehicles" else F.lit("")
        own = F.array(*[entry(visual, shown, m, v) for m, v in _values(key, total)])
        entries.append(F.when(F.col("set") == _DIMS[dim], own).otherwise(none))
        if key == "kpi_active_vehicles":
            # No vehicle is an answer, too.
            zero = F.array(entry(visual, F.lit(""), "active_vehicles", F.lit(0)))
            entries.append(F.when(F.col("set") == _DIMS[None], zero).otherwise(none))
    table = visual_facts(df, name).select(F.inline(F.concat(*entries)))
    table = table.groupBy("visual_id", "dimension", "measure").agg(F.sum("value").alias("value"))
    for visual, key in visuals.items():
        if key == "kpi_active_vehicles_diff":
            days = QUERIES[key](df)
            pairs = F.array(*[entry(visual, F.col("date").cast("string"), m, F.col(m)) for m in ("active_vehicles", "difference")])
            table = table.unionByName(days.select(F.inline(pairs)))
    return table
