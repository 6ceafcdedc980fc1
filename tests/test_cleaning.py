from pyspark.sql import functions as F

from helpers import as_dicts, at, make_readings, plan_of, same_rows
from registry.inputs import as_raw
from voltrail.operators import cleaning as C
from voltrail.schema import INTERNAL_COLUMNS, READINGS_COLUMNS


def test_clean_undoes_raw_in_one_project(spark):
    df = make_readings(spark, {}, {"vin_id": "B", "ts": at(1), "display_speed": None})
    cleaned = C.clean_readings(as_raw(df))
    assert cleaned.columns == READINGS_COLUMNS
    assert same_rows(cleaned, df)
    optimized = cleaned._jdf.queryExecution().optimizedPlan().toString()
    assert optimized.count("Project") <= 1


def test_key_is_null_when_a_part_is_null(spark):
    df = make_readings(spark, {"vin_id": None}, {"ts": None}, {"vin_id": "C", "ts": at(1.5)})
    assert {r["__primary_key"] for r in as_dicts(df)} == {None, "C_2024-01-01 01:30:00"}


def test_epoch_key(spark):
    keys = as_dicts(C.add_epoch_key(make_readings(spark, {"vin_id": "C", "ts": at(0, seconds=7)})))
    assert keys[0]["__primary_key"] == "C_1704067207"


def test_missing_and_extra_columns(spark):
    df = make_readings(spark, {}).drop("road_mode").withColumn("firmware", F.lit("x"))
    out = C.conform(df)
    assert "road_mode" not in out.columns and "firmware" not in out.columns
    assert out.columns == [c for c in READINGS_COLUMNS if c != "road_mode"]


def test_rename_is_exact_and_keeps_table_names(spark):
    df = spark.createDataFrame([(1, 2, 3)], "Fuel_Percentage int, clean_mode int, FUEL_percentage_x int")
    assert C.rename_signals(df).columns == ["fuel_percentage", "clean_mode", "FUEL_percentage_x"]


def test_drop_internal_ignores_absent_names(spark):
    df = make_readings(spark, {})
    assert C.drop_internal(df).columns == READINGS_COLUMNS[1:]
    assert not set(INTERNAL_COLUMNS) & set(C.drop_internal(as_raw(df)).columns)


def test_drift_report(spark):
    df = make_readings(spark, {}, {"display_speed": None}).drop("road_mode").withColumns(
        {"target_soc": F.col("target_soc").cast("long"), "firmware": F.lit("x")}
    )
    report = {r["column_name"]: r for r in as_dicts(C.schema_drift(df, profile=True))}
    assert len(report) == 16
    assert report["road_mode"]["status"] == "missing" and report["road_mode"]["non_null"] == 0
    assert report["firmware"]["status"] == "unexpected" and report["firmware"]["non_null"] == 2
    assert report["target_soc"]["status"] == "type_differs"
    assert report["display_speed"]["non_null"] == 1
    assert "non_null" not in C.schema_drift(df).columns


def test_no_python_in_cleaning(spark):
    assert "Python" not in plan_of(C.clean_readings(as_raw(make_readings(spark, {}))).groupBy("vin_id").count())


def test_url_decoding(spark):
    cases = {"raw%2Fa+b.zip": "raw/a b.zip", "100%": "100%", "%zz%41": "%zzA", "%C3%A9": "é", None: None, "": ""}
    df = spark.createDataFrame([(k,) for k in cases], "key string")
    got = {r["key"]: r["decoded_key"] for r in as_dicts(C.url_decode_key(df, "key"))}
    assert got == cases
