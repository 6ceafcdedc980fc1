"""Each dashboard as one table of all its visuals."""

from __future__ import annotations

from functools import partial

from pyspark.sql import DataFrame, SparkSession

from registry.inputs import READINGS, Query, readings, rounded
from voltrail.operators import measures as M
from voltrail.plans.dashboards import DASHBOARDS, dashboard

_DIMS = {None: "''", "vin_id": "vin_id", "hour": "CAST(date_trunc('hour', ts) AS VARCHAR)"}
_AVG = "ROUND(AVG(CAST({c} AS DOUBLE)), 6)"
_OTHERS = {
    "kpi_active_vehicles": [("''", "active_vehicles", "COUNT(DISTINCT vin_id)")],
    "kpi_active_vehicles_diff": [
        ("CAST(CAST(ts AS DATE) AS VARCHAR)", "active_vehicles", "COUNT(DISTINCT vin_id)"),
        ("CAST(CAST(ts AS DATE) AS VARCHAR)", "difference",
         "COUNT(DISTINCT vin_id) - lag(COUNT(DISTINCT vin_id)) OVER (ORDER BY CAST(CAST(ts AS DATE) AS VARCHAR))"),
    ],
    "gauge_avg_charging": [
        ("''", f"{how.lower()}_{M.CHARGING}", f"ROUND({how}({M.CHARGING}), 6)") for how in ("AVG", "MIN", "MAX")
    ],
    "mode_distribution": [
        ("CAST(clean_mode AS VARCHAR)", "vehicle_records", "COUNT(vin_id)"),
        ("CAST(clean_mode AS VARCHAR)", "share", "ROUND(COUNT(vin_id) / SUM(COUNT(vin_id)) OVER (), 6)"),
    ],
}


def _parts(key: str) -> list[tuple[str, str, str]]:
    if key in _OTHERS:
        return _OTHERS[key]
    dim, columns = M.AVERAGES[key]
    return [(_DIMS[dim], f"avg_{c}", _AVG.format(c=c)) for c in columns]


#: The range that a dashboard with a time filter is asked for.
_RANGES = {"filtered": ("2024-01-08", "2024-01-22")}


def _sql(name: str) -> str:
    start, end = _RANGES.get(name, ("0001-01-01", "9999-12-31"))
    chosen = f", chosen AS (SELECT * FROM readings WHERE ts >= '{start}' AND ts < '{end}')\n"
    return READINGS.rstrip() + chosen + " UNION ALL ".join(
        f"SELECT '{visual}' AS visual_id, {dim} AS dimension, '{measure}' AS measure, "
        f"CAST({value} AS DOUBLE) AS value FROM chosen" + (" GROUP BY " + dim if dim != "''" else "")
        for visual, key in DASHBOARDS[name].items()
        for dim, measure, value in _parts(key)
    )


def _run(name: str, spark: SparkSession, sf_dir: str) -> DataFrame:
    return rounded(dashboard(readings(spark, sf_dir), name, *_RANGES.get(name, ())), "value")


QUERIES = {f"dashboard_{name}": Query(partial(_run, name), _sql(name)) for name in DASHBOARDS}
