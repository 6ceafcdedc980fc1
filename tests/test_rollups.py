import pytest
from pyspark.sql import functions as F

from helpers import as_dicts, at, make_readings, plan_of, same_rows
from registry.inputs import readings, rounded
from voltrail.operators import rollups as R

SMALL = "/root/testdata/sf0.001"
PAIRS = [
    (R.vehicle_daily_summary, R.daily_summary_from_facts, ["avg_display_speed"]),
    (R.charging_behavior_analysis, R.charging_behavior_from_facts, []),
    (R.driving_mode_analysis, R.driving_mode_from_facts, ["avg_speed_in_mode"]),
]


@pytest.fixture(scope="module")
def small(spark):
    return readings(spark, SMALL)


def test_row_counts_agree(spark, small):
    total = small.count()
    sums = [
        R.vehicle_daily_summary(small).agg(F.sum("record_count")),
        R.charging_behavior_analysis(small).agg(F.sum("total_records")),
        R.driving_mode_analysis(small).agg(F.sum("mode_usage_count")),
    ]
    assert [s.first()[0] for s in sums] == [total] * 3


@pytest.mark.parametrize("direct, derived, doubles", PAIRS)
def test_one_pass_equals_three(spark, small, direct, derived, doubles):
    assert same_rows(rounded(direct(small), *doubles), rounded(derived(R.day_mode_facts(small)), *doubles))


def test_facts_of_parts_merge_to_facts_of_whole(spark, small):
    parts = R.day_mode_facts(small.where("channel_id < 3")).unionByName(R.day_mode_facts(small.where("channel_id >= 3")))
    assert same_rows(
        rounded(R.merge_facts(parts), "speed_sum"), rounded(R.day_mode_facts(small), "speed_sum")
    )


def test_vehicle_that_never_charges(spark):
    row = as_dicts(R.charging_behavior_analysis(make_readings(spark, {}, {"ts": at(1)})))[0]
    assert row["charging_sessions"] == 0 and row["avg_fuel_during_charging"] is None and row["total_records"] == 2


def test_charging_rows_are_counted_not_sessions(spark):
    df = make_readings(spark, *[{"charging_time_remain_minute": 9 - i, "ts": at(i / 60)} for i in range(9)])
    assert as_dicts(R.charging_behavior_analysis(df))[0]["charging_sessions"] == 9


def test_null_flag_and_null_mode(spark):
    df = make_readings(
        spark, {"clean_mode": None, "ress_power_low_flag": None}, {"clean_mode": None, "ress_power_low_flag": True},
        {"clean_mode": 1},
    )
    rows = {r["clean_mode"]: r for r in as_dicts(R.driving_mode_analysis(df))}
    assert rows[None]["mode_usage_count"] == 2 and rows[None]["low_power_incidents"] == 1
    assert rows[1]["low_power_incidents"] == 0


def test_all_null_measures(spark):
    df = make_readings(spark, {"fuel_percentage": None, "display_speed": None, "target_soc": None})
    for op in (R.vehicle_daily_summary, lambda d: R.daily_summary_from_facts(R.day_mode_facts(d))):
        row = as_dicts(op(df))[0]
        assert row["avg_fuel_percentage"] is None and row["max_display_speed"] is None and row["record_count"] == 1


@pytest.mark.parametrize("op", [R.vehicle_daily_summary, R.charging_behavior_analysis, R.driving_mode_analysis, R.day_mode_facts])
def test_hash_aggregate_with_partial_step(spark, small, op):
    plan = plan_of(op(small))
    assert plan.count("HashAggregate") == 2 and "SortAggregate" not in plan
    assert plan.count("Exchange") == 1
