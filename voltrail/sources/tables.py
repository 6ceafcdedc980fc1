"""Tables and the catalog: create, append, replace, audit, describe, export."""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from datetime import date

from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrail.functions.signals import date_of
from voltrail.operators.cleaning import non_null_counts
from voltrail.schema import READINGS_SCHEMA
from voltrail.session import remove_folders
from voltrail.sources.readings import read_if_there

DAY = "ts_day"
TABLE_SCHEMA = T.StructType([*READINGS_SCHEMA.fields, T.StructField(DAY, T.DateType())])


def quoted(table: str) -> str:
    return ".".join(f"`{part}`" for part in table.split("."))


def with_day(df: DataFrame) -> DataFrame:
    """Add the partition column, and cast known columns to the table's types."""
    kinds = {f.name: f.dataType for f in READINGS_SCHEMA}
    typed = [F.col(f"`{c}`").cast(kinds[c]).alias(c) if c in kinds else F.col(f"`{c}`") for c in df.columns if c != DAY]
    return df.select(*typed).withColumn(DAY, date_of())


def _by_partition(df: DataFrame, column: str) -> DataFrame:
    """Few, evenly sized files per partition value.

    The rebalance hint lets AQE merge small partitions and split the ones a
    single heavy day would make too large for one task.
    """
    return df.hint("rebalance", column)


def append_readings(df: DataFrame, path: str) -> None:
    """Append by column name to the day-partitioned Parquet folder; new columns are welcome."""
    _by_partition(with_day(df), DAY).write.mode("append").partitionBy(DAY).option(
        "compression", "snappy"
    ).parquet(path)


def append_counted(df: DataFrame, path: str) -> int:
    """Append, and count the readings while they are written."""
    if df.isEmpty():
        return 0
    seen = Observation()
    append_readings(df.observe(seen, F.count(F.lit(1)).alias("n")), path)
    return seen.get["n"]


def audit_of(spark: SparkSession, before: int, incoming: int) -> DataFrame:
    """Known counts as `append_audit` has them."""
    rows = [("before", before), ("incoming", incoming), ("after", before + incoming)]
    return spark.createDataFrame(rows, "step string, row_count long")


def read_appended(spark: SparkSession, path: str) -> DataFrame:
    """The folder under the union of all files' schemas."""
    return spark.read.option("mergeSchema", "true").parquet(path)


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """The folder under the table's own schema: no footer is opened to plan the read."""
    return read_if_there(spark, path, TABLE_SCHEMA)


def days_of(df: DataFrame) -> list[date | None]:
    """The distinct days of the readings: a list that the calendar bounds."""
    return [row.day for row in df.select(date_of().alias("day")).distinct().collect()]


def read_days(spark: SparkSession, path: str, days: Sequence[date | None]) -> DataFrame:
    """The table's rows on these days; as literals they prune partitions."""
    touched = F.col(DAY).isin([d for d in days if d is not None])
    if None in days:
        touched = touched | F.col(DAY).isNull()
    return read_table(spark, path).where(touched).drop(DAY)


def create_readings_table(spark: SparkSession, table: str, path: str | None = None) -> None:
    """The typed, day-partitioned readings table, unless it exists."""
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in READINGS_SCHEMA)
    location = f"LOCATION '{path}'" if path else ""
    spark.sql(
        f"CREATE TABLE IF NOT EXISTS {quoted(table)} ({columns}, `{DAY}` date) USING parquet "
        f"PARTITIONED BY (`{DAY}`) {location} TBLPROPERTIES ('parquet.compression' = 'snappy')"
    )


def append_to_table(df: DataFrame, table: str) -> None:
    """Append by column name to the catalog table.

    Columns the table lacks are added to it first; columns the input lacks are NULL.
    """
    spark = df.sparkSession
    incoming = with_day(df)
    known = spark.table(table).columns
    extra = [f for f in incoming.schema if f.name not in known]
    if extra:
        added = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in extra)
        spark.sql(f"ALTER TABLE {quoted(table)} ADD COLUMNS ({added})")
    target = spark.table(table).schema
    aligned = incoming.select(*[
        F.col(f"`{f.name}`") if f.name in incoming.columns else F.lit(None).cast(f.dataType).alias(f.name)
        for f in target
    ])
    _by_partition(aligned, DAY).write.mode("append").insertInto(table)


def append_audit(before: DataFrame, incoming: DataFrame) -> DataFrame:
    """Row counts before the append, of the incoming rows, and after it."""
    sides = before.agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit("before")).unionByName(
        incoming.agg(F.count(F.lit(1)).alias("n")).withColumn("stage", F.lit("incoming"))
    )
    after = F.when(F.grouping("stage") == 1, "after").otherwise(F.col("stage"))
    return sides.rollup("stage").agg(after.alias("step"), F.sum("n").alias("row_count")).select("step", "row_count")


def write_rollup(df: DataFrame, table: str, partition: str = "date", path: str | None = None) -> None:
    """Create `table` from `df`, partitioned, as Snappy Parquet."""
    writer = (
        _by_partition(df, partition).write.format("parquet").partitionBy(partition).option("compression", "snappy")
    )
    if path:
        writer = writer.option("path", path)
    writer.saveAsTable(table)


def replace_table(
    df: DataFrame, table: str, partition: str = "date", root: str | None = None, retire_days: int = 7
) -> str:
    """Full refresh of `table`; returns the folder that now holds it.

    The rows go to a new folder below `root` (the database's own by default), so
    `df` may read the old version, and a failed write leaves that in place. The
    name is a view, which one statement moves to the new folder: a reader finds
    either version whole, at any time. Versions that were replaced and are older
    than `retire_days` go; queries may read the younger ones for that long. A
    table of that name, made by other means, gives way to the view once.
    """
    spark = df.sparkSession
    database, _, name = table.rpartition(".")
    root = root or spark.catalog.getDatabase(database or spark.catalog.currentDatabase()).locationUri
    path = f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"
    _by_partition(df, partition).write.partitionBy(partition).option("compression", "snappy").parquet(path)
    if spark.catalog.tableExists(table) and spark.catalog.getTable(table).tableType != "VIEW":
        spark.sql(f"DROP TABLE {quoted(table)}")
    spark.sql(f"CREATE OR REPLACE VIEW {quoted(table)} AS SELECT * FROM parquet.`{path}`")
    remove_folders(
        spark, root, lambda own: own.startswith(f"{name}-") and not path.endswith(f"/{own}"), retire_days * 86_400)
    return path


def current_folder(spark: SparkSession, table: str) -> str:
    """The folder that holds a table made by `replace_table`."""
    details = {r.col_name: r.data_type for r in spark.sql(f"DESCRIBE TABLE EXTENDED {quoted(table)}").collect()}
    return details["View Text"].split("`")[1]


def refresh_days(df: DataFrame, path: str, partition: str = "date") -> None:
    """Replace only the partitions that `df` holds rows for."""
    _by_partition(df, partition).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
        partition
    ).option("compression", "snappy").parquet(path)


def preview_rows(df: DataFrame, n: int, order_by: Sequence[str]) -> DataFrame:
    """The first `n` rows by `order_by`, which makes the preview repeatable."""
    return df.orderBy(*order_by).limit(n)


def table_row_counts(spark: SparkSession, tables: Sequence[str]) -> DataFrame:
    """(table_name, row_count) in one job; Parquet answers a bare count from its footers."""
    counts = [
        spark.table(t).agg(F.count(F.lit(1)).alias("row_count")).select(F.lit(t).alias("table_name"), "row_count")
        for t in tables
    ]
    whole = counts[0]
    for one in counts[1:]:
        whole = whole.unionByName(one)
    return whole


def ensure_namespace(spark: SparkSession, namespace: str) -> None:
    spark.sql(f"CREATE DATABASE IF NOT EXISTS {quoted(namespace)}")


def catalog_overview(spark: SparkSession, namespace: str) -> DataFrame:
    """Create the namespace if absent, then list (namespace, table_name) for every namespace.

    The catalog's answers are metadata, which the driver holds anyway: one local relation.
    """
    ensure_namespace(spark, namespace)
    rows = [
        (name.namespace, table.tableName)
        for name in spark.sql("SHOW DATABASES").collect()
        for table in spark.sql(f"SHOW TABLES IN {quoted(name.namespace)}").collect() if not table.isTemporary
    ]
    return spark.createDataFrame(rows, "namespace string, table_name string")


def table_exists(spark: SparkSession, table: str) -> bool:
    return spark.catalog.tableExists(table)


def describe_table(spark: SparkSession, table: str, profile: bool = False) -> DataFrame:
    """(position, column_name, data_type); `profile` adds non-NULL counts from one aggregate."""
    schema = spark.table(table).schema
    listing = spark.createDataFrame(
        [(i, f.name, f.dataType.simpleString()) for i, f in enumerate(schema)],
        "position int, column_name string, data_type string",
    )
    if not profile:
        return listing
    return listing.join(non_null_counts(spark.table(table)), "column_name")


_INSTANT = {"timestampFormat": "yyyy-MM-dd'T'HH:mm:ss.SSSSSSXXX"}
EXPORT_OPTIONS = {
    "csv": {"header": "true", "escape": '"', **_INSTANT},
    "json": {"ignoreNullFields": "false", **_INSTANT},
    "parquet": {},
}


def export_query(df: DataFrame, path: str, fmt: str = "csv") -> None:
    """Write a result for download, in parallel; `fmt` is csv, json or parquet."""
    if fmt not in EXPORT_OPTIONS:
        raise ValueError(f"unknown export format {fmt!r}; choose one of {sorted(EXPORT_OPTIONS)}")
    df.write.format(fmt).options(**EXPORT_OPTIONS[fmt]).save(path)


def read_export(df: DataFrame, path: str, fmt: str = "csv") -> DataFrame:
    """The export of `df` with `df`'s own types."""
    return df.sparkSession.read.format(fmt).schema(df.schema).options(**EXPORT_OPTIONS[fmt]).load(path)


def temp_name(prefix: str) -> str:
    return f"{prefix}_{uuid.uuid4().hex[:12]}"
