import hashlib
import zipfile
from pathlib import Path

import pytest
from pyspark.sql import functions as F

from helpers import as_dicts, at, make_readings, same_rows
from registry.inputs import TABLES, as_raw, readings, rounded
from registry.stream_queries import QUERIES
from test_landing import make_zip
from voltrail.operators.filters import low_battery_alerts
from voltrail.operators.measures import trend_hourly_fuel_speed
from voltrail.operators.rollups import vehicle_daily_summary
from voltrail.operators.sessions import charging_sessions_true
from voltrail.plans import jobs
from voltrail.schema import RAW_SCHEMA
from voltrail.session import work_path
from voltrail.sources.tables import DAY, read_table
from voltrail.streaming import incremental, ingest, rollups

SMALL = "/root/testdata/sf0.001"
AVERAGES = ["avg_fuel_percentage", "avg_display_speed"]


@pytest.fixture(scope="module")
def small(spark):
    return readings(spark, SMALL)


@pytest.fixture(scope="module")
def drops(spark, small):
    """Raw drops in four files, newest readings first, so most of the data arrives late."""
    path = work_path(spark, "drops")
    for part in (3, 0, 2, 1):
        as_raw(small.where(F.col("channel_id") % 4 == part).orderBy(F.desc("ts")).coalesce(1)).write.mode("append").parquet(path)
    return path


def run(start, spark, drops, **options):
    """Twice the same query: the second run finds nothing new."""
    out, checkpoint = work_path(spark, "out"), work_path(spark, "checkpoint")
    for _ in range(2):
        stream = ingest.read_raw_stream(spark, drops, files_per_batch=1)
        start(stream, out, checkpoint, **options).awaitTermination()
    return out


def test_daily_summary_over_late_batches(spark, small, drops):
    out = run(rollups.stream_daily_summary, spark, drops)
    batches = spark.read.parquet(f"{out}/batches").select("batch_id").distinct().count()
    assert batches == 4
    got = rounded(rollups.daily_summary_so_far(spark, out), "avg_display_speed")
    assert same_rows(got, rounded(vehicle_daily_summary(small), "avg_display_speed"))


def test_hourly_trend_over_late_batches(spark, small, drops):
    out = run(rollups.stream_hourly_trend, spark, drops)
    got = rounded(rollups.hourly_trend_so_far(spark, out), *AVERAGES)
    assert same_rows(got, rounded(trend_hourly_fuel_speed(small), *AVERAGES))


def test_sliding_trend_equals_sliding_window(spark, small, drops):
    out = run(rollups.stream_hourly_trend, spark, drops)
    got = rollups.sliding_trend_so_far(spark, out)
    native = (
        small.groupBy(F.window("ts", "24 hours", "1 hour").alias("w"))
        .agg(F.count(F.lit(1)).alias("record_count"), *[F.avg(c[4:]).alias(c) for c in AVERAGES])
        .select(F.col("w.start").alias("window_start"), "record_count", *AVERAGES)
    )
    assert same_rows(rounded(got, *AVERAGES), rounded(native, *AVERAGES))


def test_sessions_over_late_batches(spark, small, drops):
    out = run(rollups.stream_charging_sessions, spark, drops)
    assert same_rows(rollups.charging_sessions_so_far(spark, out), charging_sessions_true(small))


def test_alerts(spark, small, drops):
    out = run(ingest.stream_low_battery_alerts, spark, drops, soc_below=65)
    assert same_rows(ingest.alerts_so_far(spark, out), low_battery_alerts(small, 65))


@pytest.mark.parametrize("start, compact, result, doubles", [
    (rollups.stream_daily_summary, rollups.compact_daily_summary, rollups.daily_summary_so_far, ["avg_display_speed"]),
    (rollups.stream_hourly_trend, rollups.compact_hourly_trend, rollups.hourly_trend_so_far, AVERAGES),
    (rollups.stream_charging_sessions, rollups.compact_charging_sessions, rollups.charging_sessions_so_far, []),
])
def test_compaction_changes_no_result(spark, small, drops, start, compact, result, doubles):
    out = run(start, spark, drops)
    before = rounded(result(spark, out), *doubles).cache()
    before.count()
    assert compact(spark, out) == 2
    after = result(spark, out)
    files = {f.split("file:")[1].split("part-")[0] for f in after.inputFiles()}
    assert any("compacted/batch_id=2" in f for f in files)
    assert same_rows(before, rounded(after, *doubles))
    assert compact(spark, out) == 2
    assert same_rows(before, rounded(result(spark, out), *doubles))


def test_compaction_waits_for_a_second_batch(spark):
    assert rollups.compact_daily_summary(spark, work_path(spark, "none")) is None


def test_nothing_written_yet(spark):
    assert rollups.daily_summary_so_far(spark, work_path(spark, "none")).count() == 0
    assert rollups.charging_sessions_so_far(spark, work_path(spark, "none")).count() == 0


def test_redelivered_readings_are_stored_once(spark, small, drops):
    out, checkpoint = work_path(spark, "table"), work_path(spark, "checkpoint")
    again = work_path(spark, "drops-again")
    keyless = as_raw(make_readings(spark, {"vin_id": None}, {"vin_id": None}, {"ts": None}))
    for _ in range(2):
        spark.read.schema(RAW_SCHEMA).parquet(drops).coalesce(2).write.mode("append").parquet(again)
        keyless.coalesce(1).write.mode("append").parquet(again)
        stream = ingest.read_raw_stream(spark, again, files_per_batch=1)
        ingest.stream_dedup_ingest(stream, out, checkpoint).awaitTermination()
    table = read_table(spark, out).drop(DAY)
    assert same_rows(table.where("__primary_key IS NOT NULL"), small)
    assert table.where("__primary_key IS NULL").count() == 2


def test_one_hot_reading(spark):
    landing, out = work_path(spark, "hot"), work_path(spark, "table")
    copies = make_readings(spark, {}).crossJoin(spark.range(3000)).drop("id").unionByName(make_readings(spark, {"ts": at(1)}))
    as_raw(copies).repartition(4).write.parquet(landing)
    stream = ingest.read_raw_stream(spark, landing, files_per_batch=2)
    ingest.stream_dedup_ingest(stream, out, work_path(spark, "checkpoint")).awaitTermination()
    assert read_table(spark, out).count() == 2


def test_arrivals_are_unpacked_once(spark, tmp_path):
    landing, out, log = tmp_path / "raw", str(tmp_path / "processed"), work_path(spark, "log")
    checkpoint = work_path(spark, "checkpoint")
    make_zip(landing / "a.zip", [("one.txt", b"1")])
    (landing / "note.txt").write_text("not an archive")
    ingest.ingest_arrivals_stream(spark, str(landing), out, log, checkpoint).awaitTermination()
    make_zip(landing / "b.zip", [("sub/one.txt", b"22"), ("two.txt", b"2")], zipfile.ZIP_STORED)
    ingest.ingest_arrivals_stream(spark, str(landing), out, log, checkpoint).awaitTermination()
    ingest.ingest_arrivals_stream(spark, str(landing), out, log, checkpoint).awaitTermination()
    rows = as_dicts(ingest.arrivals_log(spark, log), "batch_id", "filename")
    assert [(r["filename"], r["bytes"]) for r in rows] == [("one.txt", 1), ("sub/one.txt", 2), ("two.txt", 1)]
    assert (tmp_path / "processed" / "one.txt").read_bytes() == b"22"


def test_arrivals_query_reads_what_it_wrote_without_a_listing(spark, tmp_path):
    """No file that was unpacked is known to the driver. One archive has a name twice, one document no text."""
    documents = [(i, "text %d" % i if i % 5 else "", "en", "s", 6) for i in range(70)]
    spark.createDataFrame([*documents, (69, "text 69", "en", "s", 6)], TABLES["documents"]).coalesce(1).write.parquet(
        f"{tmp_path}/documents.parquet")
    arrived = QUERIES["ingest_arrivals_stream"].run(spark, f"file://{tmp_path}")
    assert not [f for f in arrived.inputFiles() if ".txt" in f]
    want = {(f"docs-{no // 64}.zip", f"en/doc-{no}.txt", f"doc-{no}.txt", len(text), hashlib.md5(text.encode()).hexdigest())
            for no, text, *_ in documents}
    again = ("docs-1.zip", "en/doc-69.txt", "doc-69.txt_0", 7, hashlib.md5(b"text 69").hexdigest())
    got = [(r["archive"], r["filename"], r["target"], r["bytes"], r["md5"]) for r in as_dicts(arrived)]
    assert len(got) == 71 and set(got) == want | {again}


def test_the_landing_zone_empties(spark, tmp_path):
    landing, archive, out = tmp_path / "raw", tmp_path / "done", str(tmp_path / "processed")
    log, checkpoint = work_path(spark, "log"), work_path(spark, "checkpoint")

    def arrive(*names):
        for name in names:
            make_zip(landing / "day one" / f"{name}.zip", [(f"{name}.txt", name.encode())])
        ingest.ingest_arrivals_stream(
            spark, str(landing), out, log, checkpoint, files_per_batch=1, archive=str(archive)).awaitTermination()
        return sorted(p.name for p in landing.rglob("*.zip"))

    assert len(arrive("a", "b", "c", "d")) == 1
    assert arrive("e") == ["e.zip"]
    # As a crash after the commit and before the move leaves it.
    kept = archive / str(landing).lstrip("/") / "day one" / "b.zip"
    kept.rename(landing / "day one" / "b.zip")
    assert arrive() == ["b.zip", "e.zip"]
    for moved in (1, 0):
        assert ingest.sweep_landing(spark, str(landing), log, str(archive)) == moved
        assert kept.exists() and [p.name for p in landing.rglob("*.zip")] == ["e.zip"]
    assert arrive("f") == ["f.zip"]
    rows = as_dicts(ingest.arrivals_log(spark, log), "filename")
    assert [r["filename"] for r in rows] == [f"{n}.txt" for n in "abcdef"]


def test_landing_zone_to_rollup_tables(spark, small, tmp_path):
    """Archives of Parquet drops -> processed files -> readings table -> three rollup tables."""
    parquet = tmp_path / "parquet"
    as_raw(small).repartition(3).write.parquet(f"file://{parquet}")
    for i, part in enumerate(sorted(parquet.glob("*.parquet"))):
        make_zip(tmp_path / "raw" / f"drop{i}.zip", [(f"day/{part.name}", part.read_bytes())])
    processed, table = str(tmp_path / "processed"), work_path(spark, "readings")
    assert jobs.unpack_landing(spark, str(tmp_path / "raw"), processed).log.count() == 3
    assert jobs.load_readings(spark, processed, table) == small.count()
    assert jobs.load_readings(spark, processed, table) == 0
    assert same_rows(read_table(spark, table).drop(DAY), small)
    tables = jobs.build_rollups(spark, read_table(spark, table), "fleet_job")
    jobs.build_rollups(spark, read_table(spark, table), "fleet_job")
    assert sorted(tables) == [f"fleet_job.{n}" for n in sorted(jobs.ROLLUPS)]
    assert same_rows(
        rounded(spark.table("fleet_job.vehicle_daily_summary"), "avg_display_speed"),
        rounded(vehicle_daily_summary(small), "avg_display_speed"),
    )


def test_load_without_drops_stores_the_sample(spark):
    table = work_path(spark, "readings")
    assert jobs.load_readings(spark, work_path(spark, "missing"), table) == 2
    keys = {r["__primary_key"] for r in as_dicts(read_table(spark, table))}
    assert keys == {"TEST001_1704067200", "TEST002_1704067200"}


def test_folders_stay_few_and_rows_stay(spark):
    out = work_path(spark, "shed")
    alerts = make_readings(spark, {"target_soc": 5})
    counts = []
    for batch in range(12):
        alerts.write.mode("overwrite").parquet(incremental.batch_path(out, batch))
        if batch % 3 == 2:
            ingest.compact_alerts(spark, out, grace_seconds=0)
            folder = Path("/" + out.removeprefix("file:").lstrip("/"))
            counts.append(sum(p.is_dir() for kind in ("batches", "compacted") for p in (folder / kind).iterdir()))
        assert ingest.alerts_so_far(spark, out).count() == batch + 1
    assert max(counts) <= 3
