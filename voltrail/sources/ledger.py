"""What was loaded into a readings table: drops, days that changed, and rollups brought up to date.

    _loads/drops       path, modificationTime, length and load_no of each drop
    _loads/changes     load_no and day: the days that a load added readings to
    _loads/refreshed   namespace and load_no: up to which load a namespace's rollups know the table

The folders lie below the table's and are appended to when a step is over, so a step that broke off is repeated.
"""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from voltrail.sources.readings import read_if_there

FILE = ["path", "modificationTime", "length"]
SCHEMAS = {
    "drops": "path string, modificationTime timestamp, length long, load_no long",
    "changes": "load_no long, day date",
    "refreshed": "namespace string, load_no long",
}


def _folder(table_path: str, kind: str) -> str:
    return f"{table_path.rstrip('/')}/_loads/{kind}"


def recorded(spark: SparkSession, table_path: str, kind: str) -> DataFrame:
    return read_if_there(spark, _folder(table_path, kind), SCHEMAS[kind])


def record(rows: DataFrame, table_path: str, kind: str) -> None:
    rows.coalesce(1).write.mode("append").parquet(_folder(table_path, kind))


def list_drops(spark: SparkSession, folder: str) -> DataFrame:
    """path, modificationTime, length of every file below the folder; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return files.select(*FILE)


def new_drops(spark: SparkSession, folder: str, table_path: str) -> DataFrame:
    """Drops that were never loaded, or were replaced since."""
    return list_drops(spark, folder).join(recorded(spark, table_path, "drops").select(*FILE), FILE, "left_anti")


def next_load(spark: SparkSession, table_path: str) -> int:
    last = recorded(spark, table_path, "drops").agg(F.max("load_no").alias("n")).first().n
    return 0 if last is None else last + 1


def record_load(spark: SparkSession, drops: list[Row], days: list[date | None], load_no: int, table_path: str) -> None:
    """Changes first: a load counts as done when its drops are recorded."""
    if days:
        record(spark.createDataFrame([(load_no, day) for day in days], SCHEMAS["changes"]), table_path, "changes")
    record(spark.createDataFrame([(*drop, load_no) for drop in drops], SCHEMAS["drops"]), table_path, "drops")


def days_to_refresh(spark: SparkSession, table_path: str, namespace: str) -> tuple[list[date | None], int]:
    """The days that changed since the namespace's rollups were last brought up to date, and the last load."""
    done = recorded(spark, table_path, "refreshed").where(F.col("namespace") == namespace)
    upto = done.agg(F.max("load_no").alias("n")).first().n
    changes = recorded(spark, table_path, "changes").where(F.col("load_no") > (-1 if upto is None else upto))
    rows = changes.groupBy("day").agg(F.max("load_no").alias("n")).collect()
    return [r.day for r in rows], max((r.n for r in rows), default=-1 if upto is None else upto)


def record_refresh(spark: SparkSession, table_path: str, namespace: str, load_no: int) -> None:
    record(spark.createDataFrame([(namespace, load_no)], SCHEMAS["refreshed"]), table_path, "refreshed")
