"""Scans, envelopes, table writes, catalog and exports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.cleaning_queries import COLUMNS, RAW_NAMES
from registry.inputs import RAW, READINGS, Query, on_readings, raw_readings, readings, rounded, table
from registry.rollup_queries import DAILY_SUMMARY_SQL
from voltrail.operators.cleaning import clean_readings
from voltrail.operators.dedup import dedup_readings, flatten_last_writer_wins
from voltrail.operators.rollups import vehicle_daily_summary
from voltrail.plans.jobs import build_rollups, load_new_drops, load_readings, refresh_rollups
from voltrail.session import work_path
from voltrail.sources import bi
from voltrail.sources import tables as T
from voltrail.sources.envelopes import filter_landing_keys, unpack_event_envelope
from voltrail.sources.readings import read_or_sample, sample_readings, scan_readings

SAMPLE_SQL = """SELECT * FROM (VALUES
  ('TEST001_1704067200', 'TEST001', 120, 50, 500, 480, 75, 1, 2, false, 80, CAST(60.5 AS FLOAT), 1, 1,
   TIMESTAMP '2024-01-01'),
  ('TEST002_1704067200', 'TEST002', 90, 30, 450, 430, 60, 0, 1, true, 70, CAST(45.2 AS FLOAT), 2, 2,
   TIMESTAMP '2024-01-01')
)"""


def _raw_drops(spark: SparkSession, sf_dir: str) -> str:
    path = work_path(spark, "raw-drops")
    raw_readings(spark, sf_dir).write.partitionBy("channel_id").parquet(path)
    return path


def _scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_readings(spark, _raw_drops(spark, sf_dir)).withColumn("__primary_key", F.hex("__primary_key"))


def _drifted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two drops, of which one lacks `Road_Mode`, loaded with either one first in the folder."""
    raw, both = raw_readings(spark, sf_dir), None
    for first in ("lacking", "whole"):
        drops, loaded = work_path(spark, "drops"), work_path(spark, "loaded")
        names = ["day=1", "day=2"] if first == "lacking" else ["day=2", "day=1"]
        raw.where("channel_id < 4").drop("Road_Mode").write.parquet(f"{drops}/{names[0]}")
        raw.where("channel_id >= 4").write.parquet(f"{drops}/{names[1]}")
        load_readings(spark, drops, loaded)
        rows = T.read_table(spark, loaded).withColumn("first_drop", F.lit(first))
        both = rows if both is None else both.unionByName(rows)
    return both


def _read_or_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A path that exists and one that does not."""
    present = read_or_sample(spark, _raw_drops(spark, sf_dir), clean_readings)
    return present.unionByName(read_or_sample(spark, work_path(spark, "never-written"), clean_readings))


def _landing_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    page = F.col("page_id")
    folder = F.element_at(F.array(*map(F.lit, ["raw/", "raw%2F", "in%2Fraw%2F", "other/"])), (page % 4 + 1).cast("int"))
    suffix = F.element_at(F.array(*map(F.lit, [".zip", ".7z", ".txt"])), (page % 3 + 1).cast("int"))
    key = F.concat(folder, F.replace("url", F.lit("/"), F.lit("%2F")), F.lit("+"), page.cast("string"), suffix)
    return filter_landing_keys(table(spark, sf_dir, "pages").select("page_id", key.alias("key")))


def _envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each event as a message: a notification of two objects, a test event, one without a key, or no body."""
    number = F.col("event_id").cast("string")
    body = (
        F.when(F.col("event_type") == "error", None)
        .when(F.col("event_type") == "view", F.lit('{"Event": "s3:TestEvent"}'))
        .when(F.col("event_type") == "click", F.lit('{"Records": [{"s3": {"object": {}}}, {"eventName": "x"}]}'))
        .otherwise(F.concat(
            F.lit('{"Records": [{"s3": {"object": {"key": "raw%2F'), number,
            F.lit('.zip"}}}, {"s3": {"object": {"size": 1, "key": "logs/'), number, F.lit('"}}}]}'),
        ))
    )
    return unpack_event_envelope(table(spark, sf_dir, "events").select("event_id", body.alias("body")))


def _flatten(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return flatten_last_writer_wins(pages, "url", ["page_id"])


def _append(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two appends: the second lacks `road_mode` and brings a new column."""
    df, path = readings(spark, sf_dir), work_path(spark, "appended")
    T.append_readings(df.where("channel_id < 4"), path)
    later = df.where("channel_id >= 4").drop("road_mode").withColumn("firmware", F.concat(F.lit("fw"), "channel_id"))
    T.append_readings(later, path)
    return T.read_appended(spark, path)


def _audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readings(spark, sf_dir)
    return T.append_audit(df.where("channel_id < 4"), df.where("channel_id >= 4"))


def _audit_observed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same counts, of which none is read: one from the first write, one from the second."""
    df, path = readings(spark, sf_dir), work_path(spark, "counted")
    before = T.append_counted(df.where("channel_id < 4"), path)
    return T.audit_of(spark, before, T.append_counted(df.where("channel_id >= 4"), path))


def _loads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three loads: one drop, then a second one that also delivers some of the first again, then none."""
    raw, drops, loaded = raw_readings(spark, sf_dir), work_path(spark, "drops"), work_path(spark, "loaded")
    # Every task makes its part of the rows; only the writing of the one file is left to one.
    raw.where("channel_id < 4").repartition(1).write.parquet(f"{drops}/day=1")
    runs = [load_new_drops(spark, drops, loaded)]
    raw.where("channel_id >= 2").repartition(1).write.parquet(f"{drops}/day=2")
    runs += [load_new_drops(spark, drops, loaded) for _ in range(2)]
    stored = T.read_table(spark, loaded).agg(F.count(F.lit(1)).alias("stored"), F.countDistinct("__primary_key").alias("keys"))
    told = spark.createDataFrame(
        [(no, run.drops, run.rows) for no, run in enumerate(runs, 1)], "load int, drops int, added long")
    last = stored.select(F.lit(3).alias("load"), "stored", "keys")
    return told.unionByName(last, allowMissingColumns=True).groupBy("load").agg(
        *[F.max(c).alias(c) for c in ("drops", "added", "stored", "keys")])


def _refreshed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rollups of a first load; then a load of later and of some earlier days, of which alone they are refreshed."""
    raw, drops, loaded = raw_readings(spark, sf_dir), work_path(spark, "drops"), work_path(spark, "loaded")
    name, early = T.temp_name("fleet"), F.expr("day(ts) <= 15 AND NOT (day(ts) IN (3, 4) AND channel_id = 1)")
    raw.where(early).write.parquet(f"{drops}/day=1")
    load_new_drops(spark, drops, loaded)
    refresh_rollups(spark, loaded, name, work_path(spark, name))
    raw.where(~early).write.parquet(f"{drops}/day=2")
    load_new_drops(spark, drops, loaded)
    days = refresh_rollups(spark, loaded, name)
    daily = rounded(spark.table(f"{name}.vehicle_daily_summary"), "avg_display_speed")
    return daily.withColumn("refreshed", F.col("date").isin(days))


def _namespace(spark: SparkSession, sf_dir: str) -> str:
    """A fresh namespace with the three rollups built as tables."""
    name = T.temp_name("fleet")
    build_rollups(spark, readings(spark, sf_dir), name, work_path(spark, name))
    return name


def _ctas(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = T.temp_name("daily")
    T.write_rollup(vehicle_daily_summary(readings(spark, sf_dir)), name, path=work_path(spark, name))
    return rounded(spark.table(name), "avg_display_speed")


def _replace(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Built from half the vehicles first, then replaced by the full rollup."""
    name, df = T.temp_name("daily"), readings(spark, sf_dir)
    for part in (df.where("channel_id < 4"), df):
        T.replace_table(vehicle_daily_summary(part), name, root=work_path(spark, "replaced"))
    return rounded(spark.table(name), "avg_display_speed")


def _create(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = T.temp_name("readings")
    T.create_readings_table(spark, name, work_path(spark, name))
    T.append_to_table(readings(spark, sf_dir), name)
    return spark.table(name)


def _overview(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The tables of the namespace with their row counts."""
    name = _namespace(spark, sf_dir)
    listed = T.catalog_overview(spark, name).where(F.col("namespace") == name).select("table_name")
    counts = T.table_row_counts(spark, [f"{name}.{t}" for t in ROLLUP_TABLES])
    return listed.join(counts.withColumn("table_name", F.substring_index("table_name", ".", -1)), "table_name")


def _exists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Existence of the rollups and of a table nobody made; rows where there is a table."""
    name = _namespace(spark, sf_dir)
    tables = [*ROLLUP_TABLES, "no_such_table"]
    found = [(t, T.table_exists(spark, f"{name}.{t}")) for t in tables]
    counts = T.table_row_counts(spark, [f"{name}.{t}" for t, there in found if there])
    return spark.createDataFrame(found, "table_name string, table_exists boolean").join(
        counts.withColumn("table_name", F.substring_index("table_name", ".", -1)), "table_name", "left"
    )


def _describe(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = T.temp_name("daily")
    T.write_rollup(vehicle_daily_summary(readings(spark, sf_dir)), name, path=work_path(spark, name))
    return T.describe_table(spark, name, profile=True)


def _counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    name = _namespace(spark, sf_dir)
    counts = T.table_row_counts(spark, [f"{name}.{t}" for t in ROLLUP_TABLES])
    return counts.withColumn("table_name", F.substring_index("table_name", ".", -1))


def _export(fmt: str):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        path, result = work_path(spark, f"export-{fmt}"), vehicle_daily_summary(readings(spark, sf_dir))
        T.export_query(result, path, fmt)
        return rounded(T.read_export(result, path, fmt), "avg_display_speed")

    return run


def _dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = readings(spark, sf_dir)
    return dedup_readings(df.unionByName(df))


ROLLUP_TABLES = ["vehicle_daily_summary", "charging_behavior_analysis", "driving_mode_analysis"]
ROLLUP_COUNTS = """SELECT 'vehicle_daily_summary' AS table_name,
       (SELECT COUNT(*) FROM (SELECT DISTINCT vin_id, CAST(ts AS DATE) FROM readings)) AS row_count
UNION ALL SELECT 'charging_behavior_analysis',
       (SELECT COUNT(*) FROM (SELECT DISTINCT vin_id, CAST(ts AS DATE) FROM readings))
UNION ALL SELECT 'driving_mode_analysis',
       (SELECT COUNT(*) FROM (SELECT DISTINCT vin_id, CAST(ts AS DATE), clean_mode, road_mode FROM readings))"""
ALL_READINGS = READINGS + f"SELECT {COLUMNS} FROM readings"
WITH_SAMPLE = READINGS + f"SELECT {COLUMNS} FROM readings UNION ALL {SAMPLE_SQL}"


def _bi_sql(columns: list[str]) -> str:
    casts = ["CAST(display_speed AS DECIMAL(10,2)) AS display_speed" if c == "display_speed" else c for c in columns]
    return READINGS + f"SELECT {', '.join(casts)} FROM readings"


QUERIES = {
    "scan_readings": Query(_scan, RAW + f"SELECT __primary_key, __sequence, __op_type, {RAW_NAMES} FROM raw"),
    "load_drifted_drops": Query(
        _drifted,
        READINGS + "SELECT first_drop, "
        + ", ".join("CASE WHEN channel_id >= 4 THEN road_mode END AS road_mode" if c == "road_mode" else c
                    for c in COLUMNS.split(", "))
        + ", CAST(ts AS DATE) AS ts_day FROM readings, (VALUES ('lacking'), ('whole')) v(first_drop)",
    ),
    "filter_landing_keys": Query(
        _landing_keys,
        """SELECT page_id, key FROM (
  SELECT page_id, url_decode(replace(
    (['raw/', 'raw%2F', 'in%2Fraw%2F', 'other/'])[page_id % 4 + 1] || replace(url, '/', '%2F') || '+'
    || CAST(page_id AS VARCHAR) || (['.zip', '.7z', '.txt'])[page_id % 3 + 1], '+', ' ')) AS key FROM pages)
WHERE contains(key, 'raw/') AND (ends_with(key, '.zip') OR ends_with(key, '.7z'))""",
    ),
    "unpack_event_envelope": Query(
        _envelopes,
        """SELECT event_id, unnest(['raw%2F' || event_id || '.zip', 'logs/' || event_id]) AS key
FROM events WHERE event_type NOT IN ('error', 'view', 'click')""",
    ),
    "flatten_last_writer_wins": Query(
        _flatten,
        """SELECT page_id, url, 'processed/' || base AS target FROM (
  SELECT *, row_number() OVER (PARTITION BY base ORDER BY page_id DESC) AS rn
  FROM (SELECT page_id, url, split_part(url, '/', -1) AS base FROM pages))
WHERE rn = 1""",
    ),
    "append_readings": Query(
        _append,
        READINGS + "SELECT "
        + ", ".join("CASE WHEN channel_id < 4 THEN road_mode END AS road_mode" if c == "road_mode" else c
                    for c in COLUMNS.split(", "))
        + ", CASE WHEN channel_id >= 4 THEN 'fw' || channel_id END AS firmware, CAST(ts AS DATE) AS ts_day FROM readings",
    ),
    "append_audit": Query(
        _audit,
        READINGS + """
SELECT 'before' AS step, COUNT(*) FILTER (channel_id < 4) AS row_count FROM readings
UNION ALL SELECT 'incoming', COUNT(*) FILTER (channel_id >= 4) FROM readings
UNION ALL SELECT 'after', COUNT(*) FROM readings""",
    ),
    "append_audit_observed": Query(
        _audit_observed,
        READINGS + """
SELECT 'before' AS step, COUNT(*) FILTER (channel_id < 4) AS row_count FROM readings
UNION ALL SELECT 'incoming', COUNT(*) FILTER (channel_id >= 4) FROM readings
UNION ALL SELECT 'after', COUNT(*) FROM readings""",
    ),
    "load_new_drops": Query(
        _loads,
        READINGS + """
SELECT 1 AS load, 1 AS drops, COUNT(*) FILTER (channel_id < 4) AS added, NULL AS stored, NULL AS keys FROM readings
UNION ALL SELECT 2, 1, COUNT(*) FILTER (channel_id >= 4), NULL, NULL FROM readings
UNION ALL SELECT 3, 0, 0, COUNT(*), COUNT(DISTINCT __primary_key) FROM readings""",
    ),
    "refresh_rollups": Query(
        _refreshed, f"SELECT *, day(date) > 15 OR day(date) IN (3, 4) AS refreshed FROM ({DAILY_SUMMARY_SQL})",
    ),
    "ctas_partitioned": Query(_ctas, DAILY_SUMMARY_SQL),
    "replace_table": Query(_replace, DAILY_SUMMARY_SQL),
    "inline_sample_rows": Query(
        lambda s, d: readings(s, d).unionByName(sample_readings(s)), WITH_SAMPLE
    ),
    "read_or_sample": Query(_read_or_sample, WITH_SAMPLE),
    "create_readings_table": Query(
        _create, READINGS + f"SELECT {COLUMNS}, CAST(ts AS DATE) AS ts_day FROM readings"
    ),
    "catalog_overview": Query(_overview, READINGS + ROLLUP_COUNTS),
    "table_exists": Query(
        _exists,
        READINGS + f"""SELECT table_name, table_exists, row_count FROM (
  VALUES ('vehicle_daily_summary', true), ('charging_behavior_analysis', true), ('driving_mode_analysis', true),
         ('no_such_table', false)) v(table_name, table_exists)
LEFT JOIN ({ROLLUP_COUNTS}) USING (table_name)""",
    ),
    "describe_table": Query(
        _describe,
        READINGS + """, d AS (
  SELECT COUNT(display_speed) AS speeds FROM readings GROUP BY vin_id, CAST(ts AS DATE))
SELECT CAST(position AS INT) AS position, column_name, data_type,
       (SELECT CASE WHEN column_name IN ('avg_display_speed', 'max_display_speed')
                    THEN COUNT(*) FILTER (speeds > 0) ELSE COUNT(*) END FROM d) AS non_null
FROM (VALUES (0, 'vin_id', 'string'), (1, 'avg_fuel_percentage', 'double'), (2, 'min_fuel_percentage', 'int'),
  (3, 'max_fuel_percentage', 'int'), (4, 'avg_display_speed', 'double'), (5, 'max_display_speed', 'float'),
  (6, 'avg_target_soc', 'double'), (7, 'record_count', 'bigint'), (8, 'first_record_time', 'timestamp'),
  (9, 'last_record_time', 'timestamp'), (10, 'date', 'date')) v(position, column_name, data_type)""",
    ),
    "preview_rows": Query(
        on_readings(lambda df: T.preview_rows(df, 10, ["__primary_key"])),
        READINGS + f"SELECT {COLUMNS} FROM readings ORDER BY __primary_key LIMIT 10",
    ),
    "table_row_counts": Query(_counts, READINGS + ROLLUP_COUNTS),
    "bi_dataset_full": Query(on_readings(bi.bi_dataset), _bi_sql(COLUMNS.split(", "))),
    "bi_dataset_9col": Query(on_readings(bi.bi_dataset_9col), _bi_sql(bi.BI_COLUMNS_9)),
    "bi_dataset_7col": Query(on_readings(bi.bi_dataset_7col), _bi_sql(bi.BI_COLUMNS_7)),
    "export_query": Query(_export("csv"), DAILY_SUMMARY_SQL),
    "export_query_json": Query(_export("json"), DAILY_SUMMARY_SQL),
    "export_query_parquet": Query(_export("parquet"), DAILY_SUMMARY_SQL),
    "dedup_readings_by_key": Query(_dedup, ALL_READINGS),
}
