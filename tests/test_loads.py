"""Loads that read each drop once, and rollups refreshed by day."""

import pytest
from pyspark.sql import functions as F

from helpers import at, make_readings, plan_of, same_rows
from registry.inputs import as_raw, rounded
from voltrail.operators.rollups import driving_mode_analysis, vehicle_daily_summary
from voltrail.plans import jobs
from voltrail.session import work_path
from voltrail.sources import ledger
from voltrail.sources.readings import read_if_there
from voltrail.sources.tables import DAY, read_table, temp_name


def drop(spark, folder, *rows, mode="append"):
    as_raw(make_readings(spark, *rows)).coalesce(1).write.mode(mode).parquet(folder)


def test_each_drop_is_read_once(spark, monkeypatch):
    drops, table = work_path(spark, "drops"), work_path(spark, "table")
    opened = []
    scan = jobs.scan_readings
    monkeypatch.setattr(jobs, "scan_readings", lambda *a, **k: opened.append(list(k["drops"])) or scan(*a, **k))
    drop(spark, drops, {}, {"vin_id": "B"})
    assert jobs.load_new_drops(spark, drops, table)[:3] == (1, 2, 0)
    drop(spark, drops, {}, {"vin_id": "C"}, {"ts": at(48)})
    loaded = jobs.load_new_drops(spark, drops, table)
    assert loaded[:3] == (1, 2, 2) and len(loaded.days) == 2
    assert jobs.load_new_drops(spark, drops, table) == (0, 0, 0, [])
    assert [len(paths) for paths in opened] == [1, 1, 1, 1] and opened[0] != opened[2]
    assert read_table(spark, table).count() == 4


def test_a_replaced_drop_is_read_again(spark, tmp_path):
    table = work_path(spark, "table")
    for no, rows in enumerate([[{}], [{}, {"vin_id": "B"}]]):
        drop(spark, str(tmp_path / f"out{no}"), *rows)
        (part,) = (tmp_path / f"out{no}").glob("*.parquet")
        (tmp_path / "drops").mkdir(exist_ok=True)
        (tmp_path / "drops" / "same [name].parquet").write_bytes(part.read_bytes())
        assert jobs.load_readings(spark, str(tmp_path / "drops"), table) == 1


def test_a_load_that_breaks_off_is_repeated(spark, monkeypatch):
    drops, table = work_path(spark, "drops"), work_path(spark, "table")
    drop(spark, drops, {}, {"vin_id": "B"})

    def fail(*args):
        raise RuntimeError("lost")

    with monkeypatch.context() as m:
        m.setattr(ledger, "record_load", fail)
        with pytest.raises(RuntimeError):
            jobs.load_readings(spark, drops, table)
    drop(spark, drops, {"vin_id": "C", "ts": at(24)})
    loaded = jobs.load_new_drops(spark, drops, table)
    assert loaded[:2] == (2, 1) and read_table(spark, table).count() == 3
    assert len(ledger.days_to_refresh(spark, table, "any")[0]) == 2


def test_only_changed_days_are_refreshed(spark):
    drops, table, name = work_path(spark, "drops"), work_path(spark, "table"), temp_name("fleet")
    drop(spark, drops, *[{"vin_id": f"V{i}", "ts": at(i * 24)} for i in range(5)], {"vin_id": "none", "ts": None})
    jobs.load_readings(spark, drops, table)
    assert len(jobs.refresh_rollups(spark, table, name, work_path(spark, name))) == 6
    files = lambda: {f for f in spark.table(f"{name}.vehicle_daily_summary").inputFiles()}
    before = files()
    assert jobs.refresh_rollups(spark, table, name) == [] and files() == before
    drop(spark, drops, {"vin_id": "V9", "ts": at(25)}, {"vin_id": "V9", "ts": at(24 * 9)}, {"vin_id": "V0"}, {"vin_id": "again", "ts": None})
    jobs.load_readings(spark, drops, table)
    days = jobs.refresh_rollups(spark, table, name)
    assert {str(d) for d in days} == {"2024-01-01", "2024-01-02", "2024-01-10", "None"}
    unchanged = {f for f in before if any(f"date=2024-01-0{d}" in f for d in (3, 4, 5))}
    assert unchanged and unchanged <= files()
    rows = read_table(spark, table).drop(DAY)
    for made, fresh, double in (("vehicle_daily_summary", vehicle_daily_summary, "avg_display_speed"),
                                ("driving_mode_analysis", driving_mode_analysis, "avg_speed_in_mode")):
        assert same_rows(rounded(spark.table(f"{name}.{made}"), double), rounded(fresh(rows), double))
    assert rows.where(F.col("ts").isNull()).count() == 2


def test_folders_that_are_not_there_cost_no_task(spark, tmp_path):
    none = read_if_there(spark, str(tmp_path / "none"), "id long")
    assert "ExistingRDD" not in plan_of(spark.range(3).union(none)) and none.count() == 0
