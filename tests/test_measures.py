from helpers import as_dicts, at, make_readings, plan_of
from registry.inputs import readings
from voltrail.operators import measures as M

SMALL = "/root/testdata/sf0.001"


def test_active_vehicles_ignores_null(spark):
    df = make_readings(spark, {}, {}, {"vin_id": "B"}, {"vin_id": None})
    assert as_dicts(M.kpi_active_vehicles(df)) == [{"active_vehicles": 2}]
    assert as_dicts(M.kpi_active_vehicles(df, approximate=True)) == [{"active_vehicles": 2}]


def test_mode_share(spark):
    df = make_readings(spark, {"clean_mode": 1}, {"clean_mode": 1}, {"clean_mode": 2}, {"clean_mode": 2, "vin_id": None})
    rows = {r["clean_mode"]: r for r in as_dicts(M.mode_distribution(df))}
    assert rows[1]["vehicle_records"] == 2 and rows[2]["vehicle_records"] == 1
    assert abs(rows[1]["share"] - 2 / 3) < 1e-12


def test_mode_share_without_any_vehicle(spark):
    assert as_dicts(M.mode_distribution(make_readings(spark, {"vin_id": None})))[0]["share"] is None


def test_average_counts_zeros(spark):
    df = make_readings(spark, {"charging_time_remain_minute": 0}, {"charging_time_remain_minute": 10})
    assert as_dicts(M.QUERIES["kpi_avg_charging"](df)) == [{"avg_charging_time_remain_minute": 5.0}]


def test_day_over_day(spark):
    df = make_readings(spark, {}, {"vin_id": "B"}, {"ts": at(24)}, {"ts": at(72)}, {"vin_id": "C", "ts": at(72)})
    rows = as_dicts(M.kpi_active_vehicles_diff(df), "date")
    assert [(r["active_vehicles"], r["difference"]) for r in rows] == [(2, None), (1, -1), (2, 1)]


def test_empty_input(spark):
    empty = make_readings(spark, {}).where("false")
    assert as_dicts(M.QUERIES["kpi_avg_fuel"](empty)) == [{"avg_fuel_percentage": None}]
    assert as_dicts(M.QUERIES["by_vehicle_fuel"](empty)) == []


def test_scan_reads_only_the_columns_in_use(spark):
    plan = plan_of(M.QUERIES["by_vehicle_fuel"](readings(spark, SMALL)))
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "user_id" in schema and "props" in schema
    assert "event_type" not in schema and "value" not in schema
