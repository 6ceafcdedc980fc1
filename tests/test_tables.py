import pytest
from pyspark.sql import functions as F

from helpers import as_dicts, at, make_readings, plan_of, same_rows, utc
from registry.inputs import as_raw
from voltrail.operators.filters import filter_time_range, filter_vehicles
from voltrail.operators.rollups import vehicle_daily_summary
from voltrail.operators.trends import trend_last_24h
from voltrail.plans.jobs import load_readings
from voltrail.schema import READINGS_COLUMNS, READINGS_SCHEMA
from voltrail.session import work_path
from voltrail.sources import tables as T
from voltrail.sources.bi import bi_dataset, bi_dataset_7col, bi_dataset_9col
from voltrail.sources.readings import read_if_there, read_or_sample, sample_readings, scan_readings


@pytest.fixture
def two_weeks(spark):
    return make_readings(spark, *[
        {"vin_id": f"V{i % 7}", "ts": at(i), "fuel_percentage": i % 101} for i in range(24 * 14)
    ])


def test_append_allows_missing_and_new_columns(spark, two_weeks):
    path = work_path(spark, "t")
    T.append_readings(two_weeks, path)
    T.append_readings(two_weeks.drop("road_mode").withColumn("firmware", F.lit("x")), path)
    back = T.read_appended(spark, path)
    assert back.count() == 2 * 336
    assert back.where("road_mode IS NULL AND firmware = 'x'").count() == 336
    assert set(T.read_table(spark, path).columns) == {*READINGS_COLUMNS, T.DAY}


def test_append_casts_to_the_table_types(spark):
    path = work_path(spark, "t")
    wide = make_readings(spark, {}).withColumn("target_soc", F.col("target_soc").cast("long"))
    T.append_readings(wide, path)
    T.append_readings(make_readings(spark, {}), path)
    assert T.read_appended(spark, path).select("target_soc").distinct().count() == 1


def test_reading_without_ts_is_kept(spark):
    path = work_path(spark, "t")
    T.append_readings(make_readings(spark, {"ts": None}, {}), path)
    assert T.read_table(spark, path).where("ts_day IS NULL").count() == 1


def test_time_range_prunes_partitions_and_pushes_filters(spark, two_weeks):
    path = work_path(spark, "t")
    T.append_readings(two_weeks, path)
    found = filter_time_range(T.read_table(spark, path), "2024-01-03 12:00:00", "2024-01-05 00:00:00")
    assert found.count() == 36
    plan = plan_of(found.select("fuel_percentage", "ts"))
    partition_filters = plan[plan.index("PartitionFilters"):].split("\n")[0]
    assert "ts_day" in partition_filters and "GreaterThanOrEqual(ts" in plan
    files = found.select(F.input_file_name().alias("f")).distinct()
    assert {r["f"].split("ts_day=")[1][:10] for r in files.collect()} == {"2024-01-03", "2024-01-04"}


def test_last_24h_prunes_partitions(spark, two_weeks):
    path = work_path(spark, "t")
    T.append_readings(two_weeks, path)
    trend = trend_last_24h(T.read_table(spark, path))
    scans = [line for line in plan_of(trend).split("\n") if "PartitionFilters" in line]
    assert sum("ts_day" in line.split("PartitionFilters")[1].split("PushedFilters")[0] for line in scans) >= 2
    assert same_rows(trend, trend_last_24h(two_weeks)) and trend.count() == 24


def test_read_days_reads_only_those_days(spark, two_weeks):
    path = work_path(spark, "t")
    T.append_readings(two_weeks, path)
    late = make_readings(spark, {"ts": at(30)})
    assert T.read_days(spark, path, T.days_of(late)).count() == 24
    assert T.read_days(spark, work_path(spark, "none"), T.days_of(late)).count() == 0


def test_filter_vehicles_short_long_and_frame(spark, two_weeks):
    for wanted in (["V1", "V2", "nobody"], ["V1", "V2", *[f"x{i}" for i in range(1500)]]):
        chosen = filter_vehicles(two_weeks, wanted)
        assert "LeftSemi" in plan_of(chosen) and "NestedLoop" not in plan_of(chosen) and chosen.count() == 96
    ids = spark.createDataFrame([("V1",), ("V2",), ("V2",)], "id string")
    assert filter_vehicles(two_weeks, ids).count() == 96


def test_audit(spark, two_weeks):
    rows = {r["step"]: r["row_count"] for r in as_dicts(T.append_audit(two_weeks, two_weeks.limit(6)))}
    assert rows == {"before": 336, "incoming": 6, "after": 342}
    empty = {r["step"]: r["row_count"] for r in as_dicts(T.append_audit(two_weeks.where("false"), two_weeks))}
    assert empty == {"before": 0, "incoming": 336, "after": 336}


def test_rollup_table_and_replace(spark, two_weeks):
    name = T.temp_name("rollup")
    T.write_rollup(vehicle_daily_summary(two_weeks), name)
    assert same_rows(spark.table(name), vehicle_daily_summary(two_weeks))
    assert "date" in [r["partition"].split("=")[0] for r in as_dicts(spark.sql(f"SHOW PARTITIONS {name}"))]
    T.replace_table(spark.table(name).where("vin_id = 'V1'"), name)
    assert spark.table(name).select("vin_id").distinct().count() == 1
    assert spark.table(name).where("date = '2024-01-02'").count() == 1


def test_failed_replace_keeps_the_old_table(spark, two_weeks):
    name = T.temp_name("rollup")
    T.replace_table(vehicle_daily_summary(two_weeks), name)
    broken = vehicle_daily_summary(two_weeks).withColumn("x", F.raise_error(F.lit("stop")).cast("int"))
    with pytest.raises(Exception, match="stop"):
        T.replace_table(broken, name)
    assert spark.table(name).count() == 98


def test_refresh_replaces_only_its_days(spark, two_weeks):
    path = work_path(spark, "rollup")
    T.refresh_days(vehicle_daily_summary(two_weeks), path)
    day = vehicle_daily_summary(two_weeks.where("ts < '2024-01-02'")).where("vin_id = 'V1'")
    T.refresh_days(day, path)
    back = spark.read.parquet(path)
    assert back.where("date = '2024-01-01'").count() == 1 and back.count() == 98 - 7 + 1


def test_typed_table_and_append(spark, two_weeks):
    name = T.temp_name("readings")
    T.create_readings_table(spark, name)
    T.create_readings_table(spark, name)
    assert [f.dataType for f in spark.table(name).schema][:15] == [f.dataType for f in READINGS_SCHEMA]
    T.append_to_table(two_weeks, name)
    T.append_to_table(two_weeks.drop("channel_id").withColumn("firmware", F.lit("x")), name)
    assert spark.table(name).where("firmware = 'x' AND channel_id IS NULL").count() == 336
    assert spark.table(name).where("ts_day = '2024-01-05'").count() == 48


def test_catalog(spark, two_weeks):
    namespace = T.temp_name("ns")
    T.catalog_overview(spark, namespace)
    T.write_rollup(vehicle_daily_summary(two_weeks), f"{namespace}.daily", path=work_path(spark, "daily"))
    listed = as_dicts(T.catalog_overview(spark, namespace))
    assert {"namespace": namespace, "table_name": "daily"} in listed
    assert T.table_exists(spark, f"{namespace}.daily") and not T.table_exists(spark, f"{namespace}.nope")
    described = as_dicts(T.describe_table(spark, f"{namespace}.daily"), "position")
    assert (described[0]["column_name"], described[0]["data_type"]) == ("vin_id", "string")
    assert as_dicts(T.table_row_counts(spark, [f"{namespace}.daily"]))[0]["row_count"] == 98


def test_preview_takes_ordered(spark, two_weeks):
    preview = T.preview_rows(two_weeks, 5, ["__primary_key"])
    assert "TakeOrderedAndProject" in plan_of(preview) and preview.count() == 5


@pytest.mark.parametrize("fmt", ["csv", "json", "parquet"])
def test_export_round_trip(spark, fmt):
    df = make_readings(spark, {"vin_id": 'quote " comma, end', "ts": at(0, microseconds=1)}, {"display_speed": None, "vin_id": "é"})
    path = work_path(spark, "export")
    T.export_query(df, path, fmt)
    assert same_rows(T.read_export(df, path, fmt), df)


def test_export_rejects_unknown_format(spark):
    with pytest.raises(ValueError):
        T.export_query(make_readings(spark, {}), work_path(spark, "x"), "xls")


def test_bi_projections_read_few_columns(spark, two_weeks):
    path = work_path(spark, "t")
    T.append_readings(two_weeks, path)
    table = T.read_table(spark, path)
    plan = plan_of(bi_dataset_7col(table))
    schema = plan[plan.index("ReadSchema"):].split("\n")[0]
    assert "channel_id" not in schema and "vin_id" in schema
    assert len(bi_dataset_9col(table).columns) == 9 and bi_dataset(table).columns == READINGS_COLUMNS
    assert dict(bi_dataset(table).dtypes)["display_speed"] == "decimal(10,2)"


def test_sample_rows(spark):
    df = sample_readings(spark)
    assert df.schema.names == READINGS_COLUMNS and [f.dataType for f in df.schema] == [f.dataType for f in READINGS_SCHEMA]
    rows = as_dicts(utc(df, "ts"), "vin_id")
    assert [r["__primary_key"] for r in rows] == ["TEST001_1704067200", "TEST002_1704067200"]
    assert rows[0]["ts"] == "2024-01-01 00:00:00"


def test_fallback_only_for_a_missing_path(spark, two_weeks, tmp_path):
    assert read_or_sample(spark, str(tmp_path / "missing")).count() == 2
    path = work_path(spark, "t")
    two_weeks.write.parquet(path)
    assert read_or_sample(spark, path).count() == 336
    (tmp_path / "bad").mkdir()
    (tmp_path / "bad" / "x.parquet").write_bytes(b"this is not parquet at all")
    with pytest.raises(Exception):
        read_or_sample(spark, str(tmp_path / "bad")).count()


def test_scan_with_schema_fills_missing_columns(spark, two_weeks):
    path = work_path(spark, "t")
    two_weeks.drop("road_mode").write.parquet(path)
    assert scan_readings(spark, path, READINGS_SCHEMA).where("road_mode IS NULL").count() == 336


@pytest.mark.parametrize("lacking_first", [True, False])
def test_drops_with_different_columns_lose_nothing(spark, caplog, lacking_first):
    drops, loaded = work_path(spark, "drops"), work_path(spark, "loaded")
    names = ["a", "b"] if lacking_first else ["b", "a"]
    raw = as_raw(make_readings(spark, *[{"vin_id": f"V{i}", "road_mode": i} for i in range(20)]))
    raw.where("vin_id < 'V15'").drop("Road_Mode").write.parquet(f"{drops}/part={names[0]}")
    raw.where("vin_id >= 'V15'").withColumn("firmware", F.lit("x")).write.parquet(f"{drops}/part={names[1]}")
    with caplog.at_level("INFO"):
        assert load_readings(spark, drops, loaded) == 20
    rows = T.read_table(spark, loaded)
    assert rows.where("road_mode IS NOT NULL").count() == raw.where("vin_id >= 'V15'").count()
    assert "column firmware: unexpected" in caplog.text and "0 before, 20 incoming, 20 after" in caplog.text


def test_readers_always_find_a_whole_version(spark, monkeypatch):
    """After each statement of a replacement the name gives the old or the new rows."""
    name, root = T.temp_name("whole"), work_path(spark, "versions")
    rows = lambda n: spark.range(n).select("id", F.lit("2024-01-01").cast("date").alias("date"))
    T.replace_table(rows(3), name, root=root)
    seen, run = [], spark.sql

    def watched(statement, *rest, **more):
        seen.append(spark.table(name).count())
        out = run(statement, *rest, **more)
        seen.append(spark.table(name).count())
        return out

    monkeypatch.setattr(type(spark), "sql", lambda self, *a, **k: watched(*a, **k))
    T.replace_table(rows(5), name, root=root)
    monkeypatch.undo()
    assert seen and set(seen) <= {3, 5} and spark.table(name).count() == 5


def test_old_versions_go(spark):
    name, root = T.temp_name("aged"), work_path(spark, "versions")
    rows = spark.range(3).select("id", F.lit("2024-01-01").cast("date").alias("date"))
    first = T.replace_table(rows, name, root=root)
    second = T.replace_table(rows, name, root=root)
    assert spark.read.parquet(first).count() == 3
    third = T.replace_table(rows, name, root=root, retire_days=-1)
    kept = {p for p in (first, second, third) if read_if_there(spark, p, rows.schema).count()}
    assert kept == {third} and spark.table(name).count() == 3
