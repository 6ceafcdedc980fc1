"""Streams that ingest: arrivals of archives, readings without copies, alerts."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from voltrail.functions.keys import is_archive_name
from voltrail.operators.cleaning import clean_readings
from voltrail.operators.filters import low_battery_alerts
from voltrail.schema import RAW_SCHEMA, READINGS_SCHEMA
from voltrail.session import make_folder, move_file
from voltrail.sources.archives import (
    FILES_SCHEMA,
    UNPACK_SCHEMA,
    archive_manifest,
    unpack_archives,
)
from voltrail.sources.membership import BUCKETS, add_new_readings
from voltrail.streaming.incremental import batch_path, compact_batches, read_batches, start_batches, start_each


def read_raw_stream(spark: SparkSession, path: str, files_per_batch: int = 1_000) -> DataFrame:
    """New raw Parquet drops under `path`, cleaned."""
    return clean_readings(
        spark.readStream.schema(RAW_SCHEMA).option("maxFilesPerTrigger", files_per_batch).parquet(path)
    )


def ingest_arrivals_stream(
    spark: SparkSession, landing: str, out: str, log: str, checkpoint: str, files_per_batch: int = 1_000,
    archive: str | None = None, **options
) -> StreamingQuery:
    """Unpack each archive that lands under `landing` once, into `out/<basename>`.

    The stream lists files without reading them; the checkpoint remembers which
    were done. `log` gets one row per file written. With `archive`, a folder of the
    same store outside `landing`, files of a batch move there, under their whole path,
    once the batch is committed and the next one comes: a trigger lists what is new and
    one batch, however long the stream runs. What a crash leaves behind, `sweep_landing`
    moves. Files that are no archives move along.
    """
    reader = (
        spark.readStream.format("binaryFile").schema(FILES_SCHEMA)
        .option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    )
    if archive is not None:
        make_folder(spark, archive)
        reader = reader.option("cleanSource", "archive").option("sourceArchiveDir", archive)
    arrivals = reader.load(landing).select("path", "modificationTime", "length")

    def write(files: DataFrame, batch_id: int) -> None:
        manifest = archive_manifest(files).persist(StorageLevel.MEMORY_AND_DISK)
        try:
            unpack_archives(manifest, out).write.mode("overwrite").parquet(batch_path(log, batch_id))
        finally:
            manifest.unpersist()

    return start_each(arrivals.where(is_archive_name(F.col("path"))), write, checkpoint, **options)


def arrivals_log(spark: SparkSession, log: str) -> DataFrame:
    return read_batches(spark.createDataFrame([], UNPACK_SCHEMA), log)


def sweep_landing(spark: SparkSession, landing: str, log: str, archive: str) -> int:
    """Move the archives that the log names, but that still lie in `landing`, to `archive`; returns their number.

    The log's last batch stays, as it may not be committed and may run again; a later batch starts only after a commit.
    So this may run at any time and any number of times, also beside the stream. Only what a crash between commit and move
    left is listed, a batch's files for each crash. Archives without a file are not in the log and stay.
    """
    logged = arrivals_log(spark, log)
    last = F.coalesce(logged.agg(F.max("batch_id")).scalar(), F.lit(-1))
    handled = logged.where(F.col("batch_id") < last).select(F.col("archive").alias("path")).distinct()
    there = (
        spark.read.format("binaryFile").schema(FILES_SCHEMA).option("recursiveFileLookup", "true").load(landing)
        .select("path")
    )
    return sum(move_file(spark, row.path, archive) for row in there.join(handled, "path", "left_semi").toLocalIterator())


def compact_log(spark: SparkSession, log: str, **options) -> int | None:
    """Fold the log's batches into one."""
    return compact_batches(spark.createDataFrame([], UNPACK_SCHEMA), log, **options)


def stream_dedup_ingest(
    stream: DataFrame, table_path: str, checkpoint: str, writer: str = "stream", buckets: int = BUCKETS, **options
) -> StreamingQuery:
    """Append each reading once, however late or often it is delivered.

    A batch asks the sketches of its days which readings the table may hold, and reads keys only in the buckets of
    those; see `sources.membership`. Copies inside a batch collapse before the shuffle. A batch that is run again adds
    nothing. `writer` names the stream among those that write to the table.
    """

    def write(batch: DataFrame, batch_id: int) -> None:
        add_new_readings(batch, table_path, batch_id, writer, buckets)

    return start_each(stream, write, checkpoint, **options)


def stream_low_battery_alerts(
    stream: DataFrame, out: str, checkpoint: str, soc_below: int = 20, **options
) -> StreamingQuery:
    """Alerts as they arrive: no state, no shuffle."""
    return start_batches(low_battery_alerts(stream, soc_below), out, checkpoint, **options)


def alerts_so_far(spark: SparkSession, out: str) -> DataFrame:
    return read_batches(spark.createDataFrame([], READINGS_SCHEMA), out).drop("batch_id")


def compact_alerts(spark: SparkSession, out: str, **options) -> int | None:
    """Fold the alerts' batches into one."""
    return compact_batches(spark.createDataFrame([], READINGS_SCHEMA), out, **options)
