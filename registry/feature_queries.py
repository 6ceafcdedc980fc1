"""Status, alerts, trends, sessions and health."""

from __future__ import annotations

from functools import partial

from registry.inputs import READINGS, Query, on_readings
from voltrail.operators import sessions, sketches, status, trends
from voltrail.operators.filters import low_battery_alerts

SOC_BELOW = 65
COLUMNS = (
    "__primary_key, vin_id, charging_time_remain_minute, extender_starting_point, fuel_cltc_mileage, "
    "fuel_wltc_mileage, fuel_percentage, clean_mode, road_mode, ress_power_low_flag, target_soc, "
    "display_speed, channel_id, endurance_type, ts"
)

LOW_BATTERY_SQL = READINGS + f"SELECT {COLUMNS} FROM readings WHERE ress_power_low_flag OR target_soc < {SOC_BELOW}"

SESSIONS_SQL = READINGS + """
SELECT vin_id, session_no, MIN(ts) AS session_start, MAX(ts) AS session_end, COUNT(*) AS reading_count,
       MAX(charging_time_remain_minute) - MIN(charging_time_remain_minute) AS minutes_drop
FROM (
  SELECT *, CAST(SUM(opens) OVER (PARTITION BY vin_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session_no
  FROM (
    SELECT *, CASE WHEN ts - lag(ts) OVER (PARTITION BY vin_id ORDER BY ts) <= INTERVAL 6 HOURS
                   THEN 0 ELSE 1 END AS opens
    FROM readings WHERE charging_time_remain_minute > 0
  )
) GROUP BY vin_id, session_no"""

SLIDING_SQL = READINGS + """
SELECT window_start, COUNT(*) AS record_count, ROUND(AVG(fuel_percentage), 6) AS avg_fuel_percentage,
       ROUND(AVG(CAST(display_speed AS DOUBLE)), 6) AS avg_display_speed
FROM (
  SELECT fuel_percentage, display_speed,
         unnest(generate_series(date_trunc('hour', ts) - INTERVAL 23 HOURS, date_trunc('hour', ts),
                                INTERVAL 1 HOUR)) AS window_start
  FROM readings
) GROUP BY window_start"""

QUERIES = {
    "vehicle_latest_status": Query(
        on_readings(status.vehicle_latest_status),
        READINGS + f"""
SELECT {COLUMNS} FROM (
  SELECT *, row_number() OVER (PARTITION BY vin_id ORDER BY ts DESC, __primary_key) AS rn FROM readings
) WHERE rn = 1""",
    ),
    "fuel_level_bands": Query(
        on_readings(status.fuel_level_bands),
        READINGS + """
SELECT CAST(least(floor(fuel_percentage / 20.0) * 20, 80) AS INT) AS band_low, COUNT(*) AS reading_count
FROM readings GROUP BY 1""",
    ),
    "speed_profile": Query(
        on_readings(status.speed_profile, "avg_speed", "p50_speed", "p95_speed"),
        READINGS + """
SELECT vin_id, MIN(display_speed) AS min_speed, ROUND(AVG(CAST(display_speed AS DOUBLE)), 6) AS avg_speed,
       MAX(display_speed) AS max_speed,
       ROUND(quantile_cont(CAST(display_speed AS DOUBLE), 0.5), 6) AS p50_speed,
       ROUND(quantile_cont(CAST(display_speed AS DOUBLE), 0.95), 6) AS p95_speed
FROM readings GROUP BY vin_id""",
    ),
    "low_battery_alerts": Query(
        on_readings(partial(low_battery_alerts, soc_below=SOC_BELOW)), LOW_BATTERY_SQL
    ),
    "trend_moving_average": Query(
        on_readings(trends.trend_moving_average, "fuel_moving_avg", "speed_moving_avg"),
        READINGS + """
SELECT hour, ROUND(AVG(fuel) OVER w, 6) AS fuel_moving_avg, ROUND(AVG(speed) OVER w, 6) AS speed_moving_avg
FROM (SELECT date_trunc('hour', ts) AS hour, AVG(fuel_percentage) AS fuel,
             AVG(CAST(display_speed AS DOUBLE)) AS speed FROM readings GROUP BY 1)
WINDOW w AS (ORDER BY hour ROWS BETWEEN 23 PRECEDING AND CURRENT ROW)""",
    ),
    "trend_last_24h": Query(
        on_readings(trends.trend_last_24h, "avg_display_speed"),
        READINGS + """
SELECT date_trunc('hour', ts) AS hour, AVG(fuel_percentage) AS avg_fuel_percentage,
       ROUND(AVG(CAST(display_speed AS DOUBLE)), 6) AS avg_display_speed
FROM readings WHERE ts > (SELECT MAX(ts) FROM readings) - INTERVAL 24 HOURS GROUP BY 1""",
    ),
    "driving_behavior_share": Query(
        on_readings(status.driving_behavior_share, "share"),
        READINGS + """
SELECT vin_id, clean_mode, road_mode, COUNT(*) AS mode_count,
       ROUND(COUNT(*) / SUM(COUNT(*)) OVER (PARTITION BY vin_id), 6) AS share
FROM readings GROUP BY vin_id, clean_mode, road_mode""",
    ),
    "energy_efficiency": Query(
        on_readings(status.energy_efficiency, "wltc_cltc_ratio", "avg_daily_fuel_used"),
        READINGS + """
SELECT a.vin_id, ROUND(ratio, 6) AS wltc_cltc_ratio, ROUND(used, 6) AS avg_daily_fuel_used
FROM (SELECT vin_id, AVG(fuel_wltc_mileage) / AVG(fuel_cltc_mileage) AS ratio FROM readings GROUP BY 1) a
JOIN (SELECT vin_id, AVG(used) AS used FROM (
        SELECT vin_id, MAX(fuel_percentage) - MIN(fuel_percentage) AS used
        FROM readings GROUP BY vin_id, CAST(ts AS DATE)) GROUP BY 1) b USING (vin_id)""",
    ),
    "speed_anomalies": Query(
        on_readings(status.speed_anomalies, "mean_speed", "stddev_speed"),
        READINGS + f"""
SELECT {COLUMNS}, ROUND(m, 6) AS mean_speed, ROUND(s, 6) AS stddev_speed FROM (
  SELECT *, AVG(CAST(display_speed AS DOUBLE)) OVER (PARTITION BY vin_id) AS m,
            stddev_samp(CAST(display_speed AS DOUBLE)) OVER (PARTITION BY vin_id) AS s FROM readings
) WHERE abs(display_speed - m) > 3 * s""",
    ),
    "drill_down": Query(
        on_readings(trends.drill_down, "avg_fuel_percentage", "avg_display_speed"),
        READINGS + """
SELECT date, vin_id, hour, CAST(GROUPING(date, vin_id, hour) AS INT) AS level_id, COUNT(*) AS record_count,
       ROUND(AVG(fuel_percentage), 6) AS avg_fuel_percentage,
       ROUND(AVG(CAST(display_speed AS DOUBLE)), 6) AS avg_display_speed
FROM (SELECT *, CAST(ts AS DATE) AS date, date_trunc('hour', ts) AS hour FROM readings)
GROUP BY ROLLUP (date, vin_id, hour)""",
    ),
    "multi_dim_performance": Query(
        on_readings(trends.multi_dim_performance, "avg_fuel_percentage", "avg_display_speed", "avg_target_soc"),
        READINGS + """
SELECT clean_mode, road_mode, endurance_type,
       CAST(GROUPING(clean_mode, road_mode, endurance_type) AS INT) AS level_id, COUNT(*) AS record_count,
       ROUND(AVG(CAST(display_speed AS DOUBLE)), 6) AS avg_display_speed,
       ROUND(AVG(fuel_percentage), 6) AS avg_fuel_percentage, ROUND(AVG(target_soc), 6) AS avg_target_soc
FROM readings GROUP BY CUBE (clean_mode, road_mode, endurance_type)""",
    ),
    # A sketch of less than 1,536 vehicles holds them all, so here the answer is the exact one.
    "active_vehicles_by_range": Query(
        on_readings(lambda df: sketches.active_vehicles_by_range(sketches.daily_vehicle_sketches(df))),
        READINGS + """
SELECT e.date, COUNT(DISTINCT vin_id) AS active_vehicles
FROM (SELECT DISTINCT CAST(ts AS DATE) AS date FROM readings WHERE vin_id IS NOT NULL) e
JOIN (SELECT DISTINCT CAST(ts AS DATE) AS day, vin_id FROM readings) r ON r.day BETWEEN e.date - 6 AND e.date
GROUP BY e.date""",
    ),
    # A sketch of up to 200 speeds holds them all; tests assert the bound on the rank where there are more.
    "speed_profile_of_days": Query(
        on_readings(lambda df: sketches.speed_profile_of_days(sketches.daily_speed_sketches(df)), "avg_speed"),
        READINGS + """
SELECT vin_id, MIN(display_speed) AS min_speed, ROUND(AVG(CAST(display_speed AS DOUBLE)), 6) AS avg_speed,
       MAX(display_speed) AS max_speed, quantile_disc(CAST(display_speed AS DOUBLE), 0.5) AS p50_speed,
       quantile_disc(CAST(display_speed AS DOUBLE), 0.95) AS p95_speed
FROM readings GROUP BY vin_id""",
    ),
    "charging_sessions_true": Query(on_readings(sessions.charging_sessions_true), SESSIONS_SQL),
    "battery_health": Query(
        on_readings(status.battery_health, "avg_soc", "stddev_soc", "low_flag_rate"),
        READINGS + """
SELECT vin_id, ROUND(AVG(target_soc), 6) AS avg_soc, ROUND(stddev_samp(target_soc), 6) AS stddev_soc,
       MIN(target_soc) AS min_soc,
       ROUND(AVG(CASE WHEN ress_power_low_flag THEN 1 ELSE 0 END), 6) AS low_flag_rate
FROM readings GROUP BY vin_id""",
    ),
    "alert_counts_by_day": Query(
        on_readings(partial(status.alert_counts_by_day, soc_below=SOC_BELOW)),
        READINGS + f"""
SELECT vin_id, CAST(ts AS DATE) AS date, COUNT(*) AS alert_count
FROM readings WHERE ress_power_low_flag OR target_soc < {SOC_BELOW} GROUP BY 1, 2""",
    ),
}
