"""Archives as tables: manifest, content, checksum test and unpacking.

The manifest reads only each archive's directory. Every later step deals out
stretches of `RANGE_BYTES` of an archive: a small archive is opened by one task,
which reads its members in the order they lie in, and a huge one keeps the whole
cluster busy. Content moves in chunks of `CHUNK_BYTES`, and no row or task holds a
whole archive. Tasks open the files themselves, through pyarrow: see `check_store`.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from itertools import chain

import pandas as pd
from pyarrow.fs import FileType, LocalFileSystem
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions.keys import is_landing_key
from voltrail.operators.dedup import flatten_last_writer_wins
from voltrail.operators.members import rename_duplicate_members
from voltrail.session import fan_out, qualified, send_to_tasks
from voltrail.sources.containers import (
    CHUNK_BYTES,
    Member,
    actual_crc,
    checked_chunks,
    filesystem,
    open_archive,
    stat,
)

send_to_tasks(__name__)

FILES_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
MANIFEST_SCHEMA = (
    "archive string, archive_modified timestamp, archive_bytes bigint, member_no bigint, filename string, "
    "compressed bigint, uncompressed bigint, is_directory boolean, modified timestamp_ntz, crc32 bigint, "
    "method string, offset bigint, error string"
)
CONTENT_SCHEMA = "archive string, member_no bigint, filename string, part bigint, content binary"
CHECK_SCHEMA = "archive string, member_no bigint, filename string, expected_crc32 bigint, actual_crc32 bigint, ok boolean"
UNPACK_SCHEMA = "archive string, member_no bigint, filename string, target string, bytes bigint"
UNPACKED_SCHEMA = "path string, content binary"

RANGE_BYTES = 64 * 1024 * 1024
_ROWS_PER_BATCH = 4_096


def scan_archives(spark: SparkSession, path: str) -> DataFrame:
    """(path, modificationTime, length) of every file below `path`; no content is read."""
    return (
        spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
        .select("path", "modificationTime", "length")
    )


def archive_manifest(files: DataFrame, errors: str = "raise") -> DataFrame:
    """One row per member. A broken archive fails the job, or gives one row with `error` set.

    `files` has path, modificationTime and length; where the length is unknown, the store is asked for both.
    """
    if errors not in ("raise", "report"):
        raise ValueError("errors must be 'raise' or 'report'")
    names = [c.split()[0] for c in MANIFEST_SCHEMA.split(", ")]

    def list_members(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for batch in batches:
            for path, changed, length in zip(batch["path"], batch["modificationTime"], batch["length"]):
                try:
                    if pd.isna(length):
                        changed, length = stat(path)
                    for m in open_archive(path).members():
                        rows.append((path, changed, length, *m, None))
                        if len(rows) >= _ROWS_PER_BATCH:
                            yield pd.DataFrame(rows, columns=names)
                            rows = []
                except Exception as broken:
                    if errors == "raise":
                        raise RuntimeError(f"cannot read archive {path}: {broken}") from broken
                    rows.append((path, changed, length, *[None] * len(Member._fields), str(broken)))
        if rows:
            yield pd.DataFrame(rows, columns=names)

    return files.select("path", "modificationTime", "length").mapInPandas(list_members, MANIFEST_SCHEMA)


def archive_summary(manifest: DataFrame) -> DataFrame:
    """Per archive: file size, members, unpacked bytes and the compression methods in use."""
    files = ~F.col("is_directory")
    return manifest.groupBy("archive").agg(
        F.max("archive_bytes").alias("archive_bytes"),
        F.count("filename").alias("member_count"),
        F.coalesce(F.sum("uncompressed"), F.lit(0)).alias("total_uncompressed"),
        F.array_join(F.array_sort(F.collect_set(F.when(files, F.col("method")))), ",").alias("methods"),
    )


def _spread(manifest: DataFrame) -> DataFrame:
    """File members over tasks, a stretch of an archive to a task.

    The task count is explicit, as the rows say nothing about the bytes behind them.
    """
    members = manifest.where(F.col("error").isNull() & ~F.col("is_directory"))
    stretch = F.floor(F.col("offset") / RANGE_BYTES)
    return members.repartition(fan_out(manifest.sparkSession), "archive", stretch).sortWithinPartitions("archive", "offset")


def _opened(batches: Iterator[pd.DataFrame]) -> Iterator[tuple]:
    """(reader, member, row) for each member; an archive is opened once per run of its members."""
    current, reader = None, None
    for batch in batches:
        for row in batch.itertuples(index=False):
            if row.archive != current:
                current, reader = row.archive, open_archive(row.archive)
            yield reader, Member(*[getattr(row, f) for f in Member._fields]), row


def extract_archives(manifest: DataFrame) -> DataFrame:
    """Content of every file member, one row per chunk; `part` numbers the chunks from 0."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size = 0
        for reader, member, row in _opened(batches):
            for part, chunk in enumerate(chain(checked_chunks(reader, member), [b""])):
                if chunk or part == 0:
                    rows.append((row.archive, row.member_no, row.filename, part, chunk))
                    size += len(chunk)
                if size >= CHUNK_BYTES or len(rows) >= _ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    columns = ["archive", "member_no", "filename", "part", "content"]
    return _spread(manifest).select("archive", *Member._fields).mapInPandas(read, CONTENT_SCHEMA)


def verify_member_crc(manifest: DataFrame) -> DataFrame:
    """Recompute each member's CRC32 in chunks and compare it with the manifest."""

    def check(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        for reader, member, row in _opened(batches):
            actual = actual_crc(reader, member)
            rows.append((row.archive, row.member_no, row.filename, row.crc32, actual, actual == row.crc32))
            if len(rows) >= _ROWS_PER_BATCH:
                yield pd.DataFrame(rows, columns=columns)
                rows = []
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    columns = ["archive", "member_no", "filename", "expected_crc32", "actual_crc32", "ok"]
    return _spread(manifest).select("archive", *Member._fields).mapInPandas(check, CHECK_SCHEMA)


def unpack_plan(manifest: DataFrame, out: str) -> DataFrame:
    """The members to write, with their `target`: `out/<basename>`, the last archive winning a shared name."""
    files = rename_duplicate_members(manifest.where(~F.col("is_directory")))
    return flatten_last_writer_wins(
        files, "output_name", ["archive_modified", "archive", "member_no"], out.rstrip("/") + "/"
    )


def unpack_archives(manifest: DataFrame, out: str) -> DataFrame:
    """Write every winning member to `out/<basename>`; the result logs what was written.

    The manifest is used more than once: persist it, or read it from a table.

    Writing happens when the result is computed. Each file is completed in a
    folder that only its task writes to and then takes the place of an earlier one,
    so a task that is run again repeats its work without harm, and tasks meet in
    `out` only for the one move.
    """

    def write(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows, made = [], {}
        try:
            for reader, member, row in _opened(batches):
                store, target = filesystem(row.target)
                folder = target.rsplit("/", 1)[0]
                if folder not in made:
                    made[folder] = store, f"{folder}/_writing-{uuid.uuid4().hex}"
                    store.create_dir(made[folder][1], recursive=True)
                partial = f"{made[folder][1]}/member"
                size = 0
                with store.open_output_stream(partial) as sink:
                    for chunk in checked_chunks(reader, member):
                        sink.write(chunk)
                        size += len(chunk)
                # Not every store moves onto a name that exists.
                if not isinstance(store, LocalFileSystem) and store.get_file_info(target).type != FileType.NotFound:
                    store.delete_file(target)
                store.move(partial, target)
                rows.append((row.archive, row.member_no, row.filename, row.target, size))
                if len(rows) >= _ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows = []
            if rows:
                yield pd.DataFrame(rows, columns=columns)
        finally:
            for store, own in made.values():
                store.delete_dir(own)

    columns = ["archive", "member_no", "filename", "target", "bytes"]
    winners = unpack_plan(manifest, qualified(manifest.sparkSession, out))
    return _spread(winners).select("archive", *Member._fields, "target").mapInPandas(write, UNPACK_SCHEMA)


def unpacked_files(log: DataFrame) -> DataFrame:
    """(path, content) of every file that a log of unpacking names, each once; a file that is gone gives no row.

    The log takes the place of a listing, which the driver would hold whole and make into tasks of a few files each.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        rows: list[tuple] = []
        size = 0
        for batch in batches:
            for path in batch["path"]:
                store, inner = filesystem(path)
                try:
                    with store.open_input_stream(inner) as source:
                        rows.append((path, source.read()))
                except FileNotFoundError:
                    continue
                size += len(rows[-1][1])
                if size >= CHUNK_BYTES or len(rows) >= _ROWS_PER_BATCH:
                    yield pd.DataFrame(rows, columns=columns)
                    rows, size = [], 0
        if rows:
            yield pd.DataFrame(rows, columns=columns)

    columns = ["path", "content"]
    # The names are few bytes to many files.
    paths = log.select(F.col("target").alias("path")).repartition(fan_out(log.sparkSession), "path").distinct()
    return paths.mapInPandas(read, UNPACKED_SCHEMA)


def landed_archives(files: DataFrame) -> DataFrame:
    return files.where(is_landing_key(F.col("path")))


def check_store(path: str) -> None:
    """Fails by name if this path's store cannot be opened through pyarrow, as tasks will have to."""
    try:
        filesystem(path)
    except Exception as unknown:
        raise RuntimeError(
            f"archives are read by tasks through pyarrow, which cannot open {path}: {unknown}. "
            "Give the executors access of their own, or copy the archives to a store they can open."
        ) from unknown
