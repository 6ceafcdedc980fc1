"""Daily rollups and dashboard measures."""

from __future__ import annotations

from registry.inputs import READINGS, Query, on_readings
from voltrail.operators import measures as M
from voltrail.operators import rollups as R

DAILY_SUMMARY_SQL = READINGS + """
SELECT vin_id, CAST(ts AS DATE) AS date, AVG(fuel_percentage) AS avg_fuel_percentage,
       MIN(fuel_percentage) AS min_fuel_percentage, MAX(fuel_percentage) AS max_fuel_percentage,
       ROUND(AVG(CAST(display_speed AS DOUBLE)), 6) AS avg_display_speed, MAX(display_speed) AS max_display_speed,
       AVG(target_soc) AS avg_target_soc, COUNT(*) AS record_count,
       MIN(ts) AS first_record_time, MAX(ts) AS last_record_time
FROM readings GROUP BY vin_id, CAST(ts AS DATE)"""

CHARGING_SQL = READINGS + """
SELECT vin_id, CAST(ts AS DATE) AS date, AVG(charging_time_remain_minute) AS avg_charging_time_remain,
       MAX(charging_time_remain_minute) AS max_charging_time_remain,
       COUNT(CASE WHEN charging_time_remain_minute > 0 THEN 1 END) AS charging_sessions,
       AVG(CASE WHEN charging_time_remain_minute > 0 THEN fuel_percentage END) AS avg_fuel_during_charging,
       COUNT(*) AS total_records
FROM readings GROUP BY vin_id, CAST(ts AS DATE)"""

DRIVING_MODE_SQL = READINGS + """
SELECT vin_id, CAST(ts AS DATE) AS date, clean_mode, road_mode, COUNT(*) AS mode_usage_count,
       ROUND(AVG(CAST(display_speed AS DOUBLE)), 6) AS avg_speed_in_mode, AVG(fuel_percentage) AS avg_fuel_in_mode,
       CAST(SUM(CASE WHEN ress_power_low_flag THEN 1 ELSE 0 END) AS BIGINT) AS low_power_incidents
FROM readings GROUP BY vin_id, CAST(ts AS DATE), clean_mode, road_mode"""

HOURLY_FUEL_SPEED_SQL = READINGS + """
SELECT date_trunc('hour', ts) AS hour, AVG(fuel_percentage) AS avg_fuel_percentage,
       ROUND(AVG(CAST(display_speed AS DOUBLE)), 6) AS avg_display_speed
FROM readings GROUP BY 1"""

QUERIES = {
    "vehicle_daily_summary": Query(on_readings(R.vehicle_daily_summary, "avg_display_speed"), DAILY_SUMMARY_SQL),
    "charging_behavior_analysis": Query(on_readings(R.charging_behavior_analysis), CHARGING_SQL),
    "driving_mode_analysis": Query(on_readings(R.driving_mode_analysis, "avg_speed_in_mode"), DRIVING_MODE_SQL),
    "kpi_active_vehicles": Query(
        on_readings(M.kpi_active_vehicles),
        READINGS + "SELECT COUNT(DISTINCT vin_id) AS active_vehicles FROM readings",
    ),
    "kpi_active_vehicles_diff": Query(
        on_readings(M.kpi_active_vehicles_diff),
        READINGS + """
SELECT date, active_vehicles, active_vehicles - lag(active_vehicles) OVER (ORDER BY date) AS difference
FROM (SELECT CAST(ts AS DATE) AS date, COUNT(DISTINCT vin_id) AS active_vehicles FROM readings GROUP BY 1)""",
    ),
    "gauge_avg_charging": Query(
        on_readings(M.gauge_avg_charging),
        READINGS + """
SELECT AVG(charging_time_remain_minute) AS avg_charging_time_remain_minute,
       MIN(charging_time_remain_minute) AS min_charging_time_remain_minute,
       MAX(charging_time_remain_minute) AS max_charging_time_remain_minute FROM readings""",
    ),
    "mode_distribution": Query(
        on_readings(M.mode_distribution, "share"),
        READINGS + """
SELECT clean_mode, COUNT(vin_id) AS vehicle_records,
       ROUND(COUNT(vin_id) / SUM(COUNT(vin_id)) OVER (), 6) AS share FROM readings GROUP BY clean_mode""",
    ),
}


def average_sql(dim: str | None, columns: tuple[str, ...]) -> str:
    """`AVG` of the columns over all rows, per vehicle or per hour."""
    dims = {None: "", "vin_id": "vin_id, ", "hour": "date_trunc('hour', ts) AS hour, "}[dim]
    averages = ", ".join(
        "ROUND(AVG(CAST(display_speed AS DOUBLE)), 6) AS avg_display_speed"
        if c == M.SPEED else f"AVG({c}) AS avg_{c}"
        for c in columns
    )
    return f"SELECT {dims}{averages} FROM readings" + (" GROUP BY 1" if dim else "")


for _key, (_dim, _columns) in M.AVERAGES.items():
    _round = [f"avg_{M.SPEED}"] if M.SPEED in _columns else []
    QUERIES[_key] = Query(on_readings(M.QUERIES[_key], *_round), READINGS + average_sql(_dim, _columns))
