import random
from datetime import timedelta

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from helpers import T0, as_dicts, at, make_readings, plan_of, same_rows
from voltrail.operators import ranks, sessions, status, trends
from voltrail.operators.dedup import basename_collisions, dedup_readings, flatten_last_writer_wins, new_readings
from voltrail.operators.measures import trend_hourly_fuel_speed


@pytest.fixture(scope="module")
def skewed(spark):
    """400 readings, a third of them from one vehicle; made with a fixed seed."""
    rng = random.Random(5)
    rows = []
    for i in range(400):
        vin = "HOT" if i % 3 == 0 else rng.choice(["A", "B", "C", None])
        rows.append({
            "vin_id": vin, "ts": at(rng.uniform(0, 200)), "display_speed": rng.choice([None, rng.uniform(0, 90), 7.5]),
            "charging_time_remain_minute": rng.choice([0, 0, rng.randint(1, 90)]), "fuel_percentage": rng.randint(0, 100),
        })
    return make_readings(spark, *rows).repartition(6).cache()


@pytest.fixture(scope="module")
def frame(skewed):
    return pd.DataFrame([r.asDict() for r in skewed.collect()])


def test_quantiles_equal_numpy(skewed, frame):
    got = {r["vin_id"]: r for r in as_dicts(status.speed_profile(skewed))}
    for vin, group in frame.assign(vin_id=frame.vin_id.fillna("null")).groupby("vin_id"):
        speeds = group.display_speed.dropna().astype(float)
        row = got[None if vin == "null" else vin]
        assert row["p50_speed"] == pytest.approx(np.quantile(speeds, 0.5))
        assert row["p95_speed"] == pytest.approx(np.quantile(speeds, 0.95))
        assert row["avg_speed"] == pytest.approx(speeds.mean())
        assert (row["min_speed"], row["max_speed"]) == pytest.approx((speeds.min(), speeds.max()))


def test_quantiles_keep_vehicles_without_speed(spark):
    rows = as_dicts(status.speed_profile(make_readings(spark, {"display_speed": None}, {"vin_id": "B"})), "vin_id")
    assert [r["p50_speed"] for r in rows] == [None, 10.0]


ODD_SPEEDS = [float("nan"), 10.0, 20.0, 30.0, 40.0, -0.0, 0.0, float("inf"), float("-inf"), -3.5, 1e-9, None]


@pytest.mark.parametrize("speeds", [ODD_SPEEDS, ODD_SPEEDS[:5], [float("nan")], [-0.0, 0.0, 0.0, 5.0]])
def test_quantiles_equal_percentile_on_odd_numbers(spark, speeds):
    df = make_readings(spark, *[{"display_speed": s, "ts": at(i)} for i, s in enumerate(speeds)])
    exact = df.selectExpr("percentile(cast(display_speed as double), 0.5) a", "percentile(cast(display_speed as double), 0.95) b")
    got = status.speed_profile(df).select("p50_speed", "p95_speed").first()
    assert [str(x) for x in got] == [str(x) for x in exact.first()]


def test_close_speeds_use_several_blocks(spark):
    speeds = spark.range(200_000).select(F.lit("A").alias("vin_id"), (F.col("id") / 200_000 * 15).cast("float").alias("display_speed"))
    blocks = speeds.groupBy(ranks.value_block(F.col("display_speed").cast("double"))).count()
    assert blocks.count() > 100 and blocks.agg(F.max("count")).first()[0] < 5_000
    got = status.speed_profile(speeds).first()
    exact = speeds.selectExpr("percentile(cast(display_speed as double), 0.95)").first()[0]
    assert got["p95_speed"] == pytest.approx(exact, abs=1e-12)


def test_approximate_profile_is_close(skewed):
    exact = {r["vin_id"]: r["max_speed"] for r in as_dicts(status.speed_profile(skewed))}
    assert {r["vin_id"]: r["max_speed"] for r in as_dicts(status.speed_profile_approx(skewed))} == exact


def test_numbering_spans_blocks(spark):
    df = spark.range(1000).select(
        F.when(F.col("id") % 3 == 0, "hot").otherwise("cold").alias("k"), (F.col("id") * 7 % 1000).alias("pos")
    )
    got = pd.DataFrame([r.asDict() for r in ranks.number_within(df, ["k"], "pos", "no", block_rows=64).collect()])
    want = got.sort_values("pos").groupby("k").cumcount() + 1
    assert len(got) == 1000 and (got.no == want.reindex(got.index)).all()


def test_latest_status_sorts_only_the_newest(skewed, frame):
    latest = status.vehicle_latest_status(skewed)
    want = frame.assign(vin_id=frame.vin_id.fillna("null")).groupby("vin_id").ts.max()
    assert {(r["vin_id"] or "null"): r["ts"] for r in as_dicts(latest)} == {k: v.to_pydatetime() for k, v in want.items()}
    plan = plan_of(status.vehicle_latest_status(skewed))
    assert plan.count("WindowGroupLimit") == 2 and "HashAggregate" in plan


def test_latest_status_settles_ties(spark):
    df = make_readings(spark, {"fuel_percentage": 9}, {"fuel_percentage": 3})
    assert as_dicts(status.vehicle_latest_status(df))[0]["fuel_percentage"] == 3


def test_fuel_bands(spark):
    df = make_readings(spark, *[{"fuel_percentage": f} for f in (0, 19, 20, 99, 100, None)])
    got = {r["band_low"]: r["reading_count"] for r in as_dicts(status.fuel_level_bands(df))}
    assert got == {0: 2, 20: 1, 80: 2, None: 1}


def test_anomalies_equal_brute_force(spark):
    speeds = [10.0] * 30 + [11.0] * 30 + [500.0]
    df = make_readings(spark, *[{"display_speed": s, "ts": at(i)} for i, s in enumerate(speeds)],
                       {"vin_id": "ONE"}, {"vin_id": None}, {"display_speed": None})
    rows = as_dicts(status.speed_anomalies(df))
    assert [r["display_speed"] for r in rows] == [500.0]
    assert rows[0]["stddev_speed"] == pytest.approx(np.std(speeds, ddof=1))
    assert "Window" not in plan_of(status.speed_anomalies(df))


def test_shares_add_up(skewed):
    totals = status.driving_behavior_share(skewed).groupBy("vin_id").agg(F.sum("share").alias("s"))
    assert all(abs(r["s"] - 1) < 1e-9 for r in as_dicts(totals))


def test_energy_efficiency(spark):
    df = make_readings(spark, {"fuel_percentage": 80}, {"fuel_percentage": 60, "ts": at(1)},
                       {"fuel_percentage": 50, "ts": at(24)}, {"vin_id": "B", "fuel_cltc_mileage": 0})
    rows = {r["vin_id"]: r for r in as_dicts(status.energy_efficiency(df))}
    assert rows["A"]["avg_daily_fuel_used"] == 10.0 and rows["A"]["wltc_cltc_ratio"] == pytest.approx(0.95)
    assert rows["B"]["wltc_cltc_ratio"] is None


def test_alerts_treat_unknown_as_no_alert(spark):
    df = make_readings(spark, {"ress_power_low_flag": None, "target_soc": None}, {"ress_power_low_flag": None, "target_soc": 5},
                       {"ress_power_low_flag": True, "target_soc": None, "ts": at(25)})
    rows = as_dicts(status.alert_counts_by_day(df), "date")
    assert [r["alert_count"] for r in rows] == [1, 1]


def test_drill_down_totals(skewed):
    rows = as_dicts(trends.drill_down(skewed))
    assert [r["record_count"] for r in rows if r["level_id"] == 7] == [400]
    for level in (0, 1, 3):
        assert sum(r["record_count"] for r in rows if r["level_id"] == level) == 400


def test_cube_has_all_levels(skewed):
    assert {r["level_id"] for r in as_dicts(trends.multi_dim_performance(skewed))} == set(range(8))


def test_last_24h(spark):
    df = make_readings(spark, {}, {"ts": at(30)}, {"ts": at(54)}, {"ts": at(31)})
    assert len(as_dicts(trends.trend_last_24h(df))) == 2
    assert same_rows(trends.trend_last_24h(df, hours=1000), trend_hourly_fuel_speed(df))


def test_moving_average_uses_rows_that_exist(spark):
    df = make_readings(spark, *[{"fuel_percentage": i, "ts": at(i * 5)} for i in range(30)])
    rows = as_dicts(trends.trend_moving_average(df), "hour")
    assert [r["fuel_moving_avg"] for r in rows] == [np.mean(range(max(0, i - 23), i + 1)) for i in range(30)]


def brute_sessions(frame, gap):
    found = []
    charging = frame[frame.charging_time_remain_minute > 0].assign(vin_id=lambda f: f.vin_id.fillna("null"))
    for vin, group in charging.groupby("vin_id"):
        open_rows = []
        for row in group.sort_values("ts").itertuples():
            if open_rows and row.ts - open_rows[-1].ts > gap:
                found.append((vin, open_rows))
                open_rows = []
            open_rows.append(row)
        found.append((vin, open_rows))
    return sorted(
        (vin, rows[0].ts.to_pydatetime(), rows[-1].ts.to_pydatetime(), len(rows),
         max(r.charging_time_remain_minute for r in rows) - min(r.charging_time_remain_minute for r in rows))
        for vin, rows in found
    )


@pytest.mark.parametrize("hours", [1, 3, 6])
def test_sessions_equal_brute_force(skewed, frame, hours):
    got = sessions.charging_sessions_true(skewed, hours * 3600).collect()
    assert sorted(
        (r["vin_id"] or "null", r["session_start"], r["session_end"], r["reading_count"], r["minutes_drop"]) for r in got
    ) == brute_sessions(frame, timedelta(hours=hours))


@pytest.mark.parametrize("block_slices", [1, 2, 7])
def test_sessions_over_many_blocks(skewed, frame, block_slices):
    slices = sessions.charging_slices(skewed, 3600)
    got = sessions.sessions_from_slices(slices, 3600, block_slices).collect()
    assert sorted(
        (r["vin_id"] or "null", r["session_start"], r["session_end"], r["reading_count"], r["minutes_drop"]) for r in got
    ) == brute_sessions(frame, timedelta(hours=1))
    for vin in {r["vin_id"] for r in got}:
        own = sorted((r["session_no"], r["session_start"]) for r in got if r["vin_id"] == vin)
        assert [no for no, _ in own] == list(range(1, len(own) + 1)) and own == sorted(own, key=lambda x: x[1])


def test_sessions_scan_once_and_join_once(spark):
    """A busy vehicle with a gap of a minute meets in blocks, which spread over tasks."""
    on = {"charging_time_remain_minute": 5}
    busy = make_readings(spark, {**on}).crossJoin(spark.range(4000)).withColumn(
        "ts", F.timestamp_seconds(F.unix_seconds("ts") + F.col("id") * 61 - F.col("id") % 5)).drop("id")
    got = sessions.sessions_from_slices(sessions.charging_slices(busy, 60), 60, 64)
    native = busy.groupBy("vin_id", F.session_window("ts", "60 seconds 1 microsecond")).count()
    assert got.count() == native.count() > 500
    plan = plan_of(sessions.charging_sessions_true(make_readings(spark, {**on}), 60))
    assert plan.count("Join ") <= 1 and plan.count("Exchange hashpartitioning") <= 8


def test_sessions_equal_session_window(skewed):
    ours = sessions.charging_sessions_true(skewed, 7200).select("vin_id", "session_start", "reading_count")
    native = (
        skewed.where("charging_time_remain_minute > 0").groupBy("vin_id", F.session_window("ts", "2 hours").alias("w"))
        .agg(F.count(F.lit(1)).alias("reading_count"))
        .select("vin_id", F.col("w.start").alias("session_start"), "reading_count")
    )
    assert same_rows(ours, native)


def test_gap_limit_is_inclusive(spark):
    on = {"charging_time_remain_minute": 5}
    df = make_readings(spark, {**on}, {**on, "ts": at(6)}, {**on, "ts": at(12, microseconds=1)}, {"ts": at(3)})
    assert sorted(r["reading_count"] for r in sessions.charging_sessions_true(df).collect()) == [1, 2]


def test_sessions_before_the_epoch(spark):
    on = {"charging_time_remain_minute": 5}
    old = [T0.replace(year=1969, month=12, day=31, hour=h) for h in (1, 5, 23)]
    df = make_readings(spark, *[{**on, "ts": t} for t in old])
    assert sorted(r["reading_count"] for r in sessions.charging_sessions_true(df).collect()) == [1, 2]


def test_append_twice_and_dedup_equals_once(skewed):
    assert same_rows(dedup_readings(skewed.unionByName(skewed)), skewed.distinct())


def test_dedup_keeps_rows_without_key(spark):
    df = make_readings(spark, {"vin_id": None, "fuel_percentage": 1}, {"vin_id": None, "fuel_percentage": 2}, {}, {})
    assert dedup_readings(df).count() == 3
    assert "WindowGroupLimit" in plan_of(dedup_readings(df))


def test_dedup_of_differing_copies_is_repeatable(spark):
    rows = [{"fuel_percentage": f} for f in (7, 3, 9)]
    picks = {dedup_readings(make_readings(spark, *order)).first()["fuel_percentage"] for order in (rows, rows[::-1])}
    assert picks == {3}


def test_new_readings(spark):
    table = make_readings(spark, {}, {"vin_id": None, "fuel_percentage": 1})
    incoming = make_readings(spark, {}, {"vin_id": None, "fuel_percentage": 1}, {"vin_id": None, "fuel_percentage": 2},
                             {"vin_id": "B"}, {"vin_id": "B"})
    rows = as_dicts(new_readings(incoming, table))
    assert sorted((r["vin_id"] or "", r["fuel_percentage"]) for r in rows) == [("", 2), ("B", 50)]


def test_new_readings_shuffles_the_incoming_rows_once(spark):
    table = make_readings(spark, {})
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = plan_of(new_readings(make_readings(spark, {}, {"vin_id": "B"}), table))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "SortMergeJoin" in plan and plan.count("Exchange") == 2


def test_last_writer_wins(spark):
    df = spark.createDataFrame(
        [("a/x.parquet", 1), ("b/x.parquet", 2), ("c/y.parquet", 1), ("d/x.parquet", None), ("z.parquet", 1)],
        "path string, seen int",
    )
    got = {(r["target"], r["path"]) for r in as_dicts(flatten_last_writer_wins(df, "path", ["seen"]))}
    assert got == {("processed/x.parquet", "b/x.parquet"), ("processed/y.parquet", "c/y.parquet"),
                   ("processed/z.parquet", "z.parquet")}
    assert as_dicts(basename_collisions(df, "path")) == [{"basename": "x.parquet", "paths": 3}]
