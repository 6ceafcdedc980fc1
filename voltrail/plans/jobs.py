"""The end-to-end jobs: landing zone -> readings table -> rollup tables.

    python -m voltrail.plans.jobs unpack  LANDING PROCESSED
    python -m voltrail.plans.jobs load    PROCESSED READINGS
    python -m voltrail.plans.jobs rollups READINGS NAMESPACE
    python -m voltrail.plans.jobs refresh READINGS NAMESPACE
"""

from __future__ import annotations

import logging
import sys
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrail.functions.keys import decode_key, is_archive_name, is_landing_key
from voltrail.operators.cleaning import clean_readings, drop_internal, rename_signals, schema_drift
from voltrail.operators.dedup import basename_collisions
from voltrail.operators.rollups import (
    charging_behavior_from_facts,
    daily_summary_from_facts,
    day_mode_facts,
    driving_mode_from_facts,
)
from voltrail.schema import READINGS_SCHEMA, SIGNAL_SCHEMA
from voltrail.session import build_session, fan_out, qualified, written
from voltrail.sources import ledger
from voltrail.sources.archives import archive_manifest, check_store, scan_archives, unpack_archives
from voltrail.sources.envelopes import unpack_event_envelope
from voltrail.sources.membership import add_new_readings
from voltrail.sources.readings import sample_readings, scan_readings
from voltrail.sources.tables import (
    current_folder,
    ensure_namespace,
    read_days,
    read_table,
    refresh_days,
    replace_table,
    table_exists,
    table_row_counts,
)

LOG = logging.getLogger(__name__)

ROLLUPS = {
    "vehicle_daily_summary": daily_summary_from_facts,
    "charging_behavior_analysis": charging_behavior_from_facts,
    "driving_mode_analysis": driving_mode_from_facts,
}


class Unpacked(NamedTuple):
    """log: what was written. skipped: files that are no archives by name. collisions: names that several members have."""

    log: DataFrame
    skipped: DataFrame
    collisions: DataFrame


def unpack_landing(spark: SparkSession, landing: str, processed: str) -> Unpacked:
    """Unpack every archive under `landing`, whatever its folders are called."""
    check_store(landing)
    files = scan_archives(spark, landing)
    named = is_archive_name(F.col("path"))
    return _unpack(spark, files.where(named), files.where(~named).select("path"), processed)


def unpack_messages(spark: SparkSession, messages: DataFrame, store: str, processed: str, body: str = "body") -> Unpacked:
    """Unpack the archives that storage notifications name: message, key, filter, unpack.

    `store` is the root that keys are relative to. Keys outside `raw/` and objects that are no archives are skipped.
    """
    check_store(store)
    keys = unpack_event_envelope(messages.select(body), body).select(decode_key(F.col("key")).alias("key")).distinct()
    path = F.concat(F.lit(qualified(spark, store.rstrip("/")) + "/"), F.col("key")).alias("path")
    landed = is_landing_key(F.col("key"))
    files = keys.where(landed).select(
        path, F.lit(None).cast("timestamp").alias("modificationTime"), F.lit(None).cast("long").alias("length"))
    # The keys are few bytes to many archives, which one task would open one after the other.
    files = files.repartition(fan_out(spark), "path")
    return _unpack(spark, files, keys.where(~landed).select(path), processed)


def _unpack(spark: SparkSession, files: DataFrame, skipped: DataFrame, processed: str) -> Unpacked:
    manifest = written(archive_manifest(files), "manifest")
    log = written(unpack_archives(manifest, processed), "unpack-log")
    members = manifest.where(~F.col("is_directory"))
    place = F.concat_ws("/", "archive", "filename")
    shared = basename_collisions(members.select(place.alias("path")), "path")
    report = Unpacked(log, written(skipped, "skipped"), written(shared, "collisions"))
    if number := report.skipped.count():
        LOG.warning("%d files skipped, as they are no archives", number)
    if number := report.collisions.count():
        LOG.warning("%d names shared by several members, of which the last one stays", number)
    return report


def drift_of(spark: SparkSession, processed: str, drops: Sequence[str] | None = None) -> DataFrame:
    """Missing, unexpected and differing columns over these drops (all by default), from their footers."""
    seen = rename_signals(drop_internal(scan_readings(spark, processed, merge_schema=True, drops=drops)))
    expected = T.StructType([f for f in READINGS_SCHEMA if f.name != "__primary_key"])
    return schema_drift(seen, expected).where("status <> 'ok'")


class Loaded(NamedTuple):
    """drops: how many were read. rows: readings added. before: readings on the touched days. days: those that changed."""

    drops: int
    rows: int
    before: int
    days: list


def load_new_drops(spark: SparkSession, processed: str, table_path: str) -> Loaded:
    """Read each drop once and append the readings the table lacks.

    A ledger below the table tells drops that are new, or were replaced, from those already loaded; only the new ones are
    opened. Each is read under the full set of signals, so one that lacks a column takes it from no other. Drift in them
    and the counts before, incoming and after are logged; the counts come from the table's index and from the write
    itself. A load that breaks off is repeated whole and adds nothing twice. A missing input folder loads the sample rows.
    """
    try:
        # The driver holds the names of the files of any scan.
        found = ledger.new_drops(spark, processed, table_path).collect()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        added = add_new_readings(_typed(sample_readings(spark)), table_path, 0, "sample")
        return Loaded(0, added.rows, added.before, added.days)
    paths = [row.path for row in found]
    if not paths:
        return Loaded(0, 0, 0, [])
    for row in drift_of(spark, processed, paths).collect():
        LOG.warning("column %s: %s (expected %s, found %s)", row.column_name, row.status, row.expected_type, row.actual_type)
    incoming = _typed(clean_readings(scan_readings(spark, processed, SIGNAL_SCHEMA, drops=paths)))
    load_no = ledger.next_load(spark, table_path)
    added = add_new_readings(incoming, table_path, load_no, "load")
    ledger.record_load(spark, found, added.days, load_no, table_path)
    LOG.info(
        "%d drops; readings on the touched days: %d before, %d incoming, %d after",
        len(paths), added.before, added.rows, added.before + added.rows)
    return Loaded(len(paths), added.rows, added.before, added.days)


def load_readings(spark: SparkSession, processed: str, table_path: str) -> int:
    """Load the new drops; returns the number of readings added."""
    return load_new_drops(spark, processed, table_path).rows


def _typed(df: DataFrame) -> DataFrame:
    """All table columns in the table's types; columns the drops lack are NULL."""
    return df.select(*[
        (F.col(f.name) if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name)
        for f in READINGS_SCHEMA
    ])


def build_rollups(
    spark: SparkSession, readings: DataFrame, namespace: str, root: str | None = None
) -> dict[str, str]:
    """Rebuild the three rollup tables from a single scan of the readings.

    The shared facts are written once to the shared folder, which also spares a
    lost executor's work a second scan. Returns table name -> folder.
    """
    ensure_namespace(spark, namespace)
    facts = written(day_mode_facts(readings), "day-mode-facts")
    paths = {
        f"{namespace}.{name}": replace_table(derive(facts), f"{namespace}.{name}", root=root)
        for name, derive in ROLLUPS.items()
    }
    for row in table_row_counts(spark, list(paths)).collect():
        LOG.info("%s: %d rows", row.table_name, row.row_count)
    return paths


def refresh_rollups(spark: SparkSession, table_path: str, namespace: str, root: str | None = None) -> list:
    """Bring the three rollups up to date on the days that changed since the last time; returns those days.

    Only these days' readings are read, and only their partitions are written. Where there are no rollups yet they are
    built. Refreshing a day again gives the same rows, so a refresh that breaks off is repeated.
    """
    days, load_no = ledger.days_to_refresh(spark, table_path, namespace)
    if not all(table_exists(spark, f"{namespace}.{name}") for name in ROLLUPS):
        build_rollups(spark, read_table(spark, table_path), namespace, root)
    elif days:
        facts = written(day_mode_facts(read_days(spark, table_path, days)), "day-mode-facts")
        for name, derive in ROLLUPS.items():
            refresh_days(derive(facts), current_folder(spark, f"{namespace}.{name}"))
    if days:
        ledger.record_refresh(spark, table_path, namespace, load_no)
    return days


def main(argv: list[str]) -> int:
    if len(argv) != 3 or argv[0] not in ("unpack", "load", "rollups", "refresh"):
        print(__doc__)
        return 2
    step, source, target = argv
    spark = build_session(f"voltrail-{step}")
    if step == "unpack":
        print(f"files written: {unpack_landing(spark, source, target).log.count()}")
    elif step == "load":
        print(f"readings appended: {load_readings(spark, source, target)}")
    elif step == "refresh":
        print(f"days refreshed: {len(refresh_rollups(spark, source, target))}")
    else:
        for table, path in build_rollups(spark, read_table(spark, source), target).items():
            print(f"{table}: {path}")
    spark.stop()
    return 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
