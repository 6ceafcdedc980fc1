import pytest
from pyspark.sql import functions as F

from helpers import as_dicts, at, make_readings
from registry.inputs import readings
from voltrail.functions.signals import date_of
from voltrail.operators import sketches as S
from voltrail.operators.status import speed_profile

SMALL = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def given(spark):
    return readings(spark, SMALL)


def test_vehicles_of_ranges_are_within_the_bound(given):
    got = {r["date"]: r["active_vehicles"] for r in as_dicts(S.active_vehicles_by_range(S.daily_vehicle_sketches(given)))}
    days = given.select(date_of().alias("date"), "vin_id").distinct()
    ends = days.select(F.col("date").alias("end")).distinct()
    exact = days.join(ends, F.col("date").between(F.date_sub("end", 6), F.col("end"))).groupBy("end").agg(
        F.count_distinct("vin_id").alias("n"))
    want = {r["end"]: r["n"] for r in as_dicts(exact)}
    assert got.keys() == want.keys()
    assert all(abs(got[d] - n) <= 0.03 * n for d, n in want.items())


def test_vehicles_of_odd_readings(spark):
    df = make_readings(spark, {}, {"vin_id": "B"}, {"ts": at(24)}, {"vin_id": None}, {"ts": None}, {"vin_id": "C", "ts": at(24 * 9)})
    rows = as_dicts(S.active_vehicles_by_range(S.daily_vehicle_sketches(df), days=2), "date")
    assert [r["active_vehicles"] for r in rows] == [2, 2, 1]
    assert as_dicts(S.active_vehicles_by_range(S.daily_vehicle_sketches(df.where("false")))) == []


def test_speeds_merged_over_days_have_the_right_rank(given):
    fleet = given.withColumn("vin_id", F.lit("all"))
    row = as_dicts(S.speed_profile_of_days(S.daily_speed_sketches(fleet)))[0]
    speeds = fleet.select("display_speed").where("display_speed IS NOT NULL")
    n = speeds.count()
    for name, q in (("p50_speed", 0.5), ("p95_speed", 0.95)):
        below = speeds.where(F.col("display_speed") < row[name]).count() / n
        upto = speeds.where(F.col("display_speed") <= row[name]).count() / n
        assert below - 0.03 <= q <= upto + 0.03
    exact = as_dicts(speed_profile(fleet))[0]
    assert (row["min_speed"], row["max_speed"]) == (exact["min_speed"], exact["max_speed"])
    assert row["avg_speed"] == pytest.approx(exact["avg_speed"], rel=1e-9)


def test_speeds_of_a_range_and_of_odd_readings(spark):
    df = make_readings(
        spark, {"display_speed": 10.0}, {"display_speed": 30.0, "ts": at(24)}, {"display_speed": float("nan")},
        {"vin_id": "B", "display_speed": None})
    daily = S.daily_speed_sketches(df)
    rows = {r["vin_id"]: r for r in as_dicts(S.speed_profile_of_days(daily))}
    assert rows["B"]["p50_speed"] is None and rows["B"]["avg_speed"] is None
    other = next(r for v, r in rows.items() if v != "B")
    assert (other["min_speed"], other["avg_speed"], other["max_speed"], other["p95_speed"]) == (10.0, 20.0, 30.0, 30.0)
    second = as_dicts(S.speed_profile_of_days(daily, start=str(at(24))[:10]))
    assert [r["p50_speed"] for r in second] == [30.0]
    assert as_dicts(S.speed_profile_of_days(S.daily_speed_sketches(df.where("false")))) == []
