import hashlib
import io
import os
import struct
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from helpers import as_dicts, plan_of
from registry.archive_queries import QUERIES
from registry.inputs import TABLES
from voltrail.functions.content import MAGIC_NUMBERS, digests
from voltrail.operators import members as M
from voltrail.plans import jobs
from voltrail.sources import archives
from voltrail.session import qualified, work_path
from voltrail.sources.archives import (
    archive_manifest,
    archive_summary,
    extract_archives,
    landed_archives,
    scan_archives,
    unpack_archives,
    unpacked_files,
    verify_member_crc,
)
from voltrail.sources.containers import CHUNK_BYTES, filesystem
from voltrail.sources.envelopes import filter_landing_keys, unpack_event_envelope


def make_zip(path, members, method=zipfile.ZIP_DEFLATED):
    path.parent.mkdir(parents=True, exist_ok=True)
    with zipfile.ZipFile(path, "w", method) as archive:
        for name, content in members:
            archive.writestr(name, content)
    return path


@pytest.fixture
def landing(tmp_path):
    root = tmp_path / "raw"
    make_zip(root / "a.zip", [("in/one.txt", b"one"), ("in/", b""), ("two.txt", b"two" * 1000), ("empty.txt", b"")])
    make_zip(root / "day2" / "b.zip", [("other/one.txt", b"ONE")], zipfile.ZIP_BZIP2)
    make_zip(root / "none.zip", [])
    return root


def test_manifest_and_summary(spark, landing):
    manifest = archive_manifest(scan_archives(spark, str(landing)))
    rows = {(r["archive"].rsplit("/", 1)[1], r["filename"]): r for r in as_dicts(manifest)}
    assert len(rows) == 5
    two = rows["a.zip", "two.txt"]
    assert (two["uncompressed"], two["method"], two["crc32"]) == (3000, "deflate", zlib.crc32(b"two" * 1000))
    assert rows["a.zip", "in/"]["is_directory"] and rows["b.zip", "other/one.txt"]["method"] == "bzip2"
    summary = {r["archive"].rsplit("/", 1)[1]: r for r in as_dicts(archive_summary(manifest))}
    assert summary["a.zip"]["member_count"] == 4 and summary["a.zip"]["total_uncompressed"] == 3003
    assert summary["a.zip"]["methods"] == "deflate"
    assert summary["a.zip"]["archive_bytes"] == (landing / "a.zip").stat().st_size


def test_manifest_reads_no_content_column(spark, landing):
    assert "content" not in plan_of(scan_archives(spark, str(landing))).split("FileScan")[1].split("Batched")[0]


def test_extract_content_whole_and_in_chunks(spark, tmp_path):
    big = bytes(range(256)) * (CHUNK_BYTES // 256 * 2 + 10)
    make_zip(tmp_path / "raw" / "big.zip", [("big.bin", big), ("none", b""), ("small", b"s")], zipfile.ZIP_STORED)
    manifest = archive_manifest(scan_archives(spark, str(tmp_path)))
    assert all(r["ok"] for r in as_dicts(verify_member_crc(manifest)))
    rows = as_dicts(extract_archives(manifest), "filename", "part")
    parts = [r for r in rows if r["filename"] == "big.bin"]
    assert [r["part"] for r in parts] == [0, 1, 2]
    assert b"".join(bytes(r["content"]) for r in parts) == big
    assert {r["filename"]: bytes(r["content"]) for r in rows if r["filename"] != "big.bin"} == {"none": b"", "small": b"s"}


def test_odd_file_and_member_names(spark, tmp_path):
    make_zip(tmp_path / "raw" / "sp ace+é%41.zip", [("d/ü b%20.txt", b"x")])
    out = tmp_path / "out put"
    files = landed_archives(scan_archives(spark, str(tmp_path / "raw")))
    log = as_dicts(unpack_archives(archive_manifest(files), str(out)))
    assert log[0]["archive"].endswith("sp ace+é%41.zip") and [p.name for p in out.iterdir()] == ["ü b%20.txt"]


def test_broken_archive_fails_or_is_reported(spark, landing):
    whole = (landing / "a.zip").read_bytes()
    (landing / "cut.zip").write_bytes(whole[: len(whole) // 2])
    (landing / "text.zip").write_bytes(b"no archive at all")
    files = scan_archives(spark, str(landing))
    with pytest.raises(Exception, match="cannot read archive"):
        archive_manifest(files).collect()
    reported = [r for r in as_dicts(archive_manifest(files, errors="report")) if r["error"]]
    assert sorted(r["archive"].rsplit("/", 1)[1] for r in reported) == ["cut.zip", "text.zip"]


def test_other_containers_are_reported(spark, tmp_path):
    (tmp_path / "x.zip").write_bytes(bytes.fromhex(MAGIC_NUMBERS["7z"]) + b"rest")
    row = as_dicts(archive_manifest(scan_archives(spark, str(tmp_path)), errors="report"))[0]
    assert "not a known archive" in row["error"]


def test_a_small_archive_is_one_task_and_a_large_one_several(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(archives, "RANGE_BYTES", 100_000)
    make_zip(tmp_path / "small.zip", [(f"{i}.txt", b"x") for i in range(200)])
    make_zip(tmp_path / "large.zip", [(f"{i}.bin", os.urandom(50_000)) for i in range(40)], zipfile.ZIP_STORED)
    spread = archives._spread(archive_manifest(scan_archives(spark, str(tmp_path))))
    tasks = spread.withColumn("task", F.spark_partition_id()).groupBy("archive").agg(F.count_distinct("task").alias("n"))
    found = {r["archive"].rsplit("/", 1)[1]: r["n"] for r in tasks.collect()}
    assert found["small.zip"] == 1 and found["large.zip"] > 1


def test_landing_folders_of_any_name(spark, tmp_path):
    """No archive is left out without a word; other files and shared names are reported."""
    make_zip(tmp_path / "in" / "a.zip", [("x/one.txt", b"1"), ("two.txt", b"2")])
    make_zip(tmp_path / "in" / "draw" / "b.zip", [("one.txt", b"3")])
    (tmp_path / "in" / "notes.md").write_text("no archive")
    done = jobs.unpack_landing(spark, str(tmp_path / "in"), str(tmp_path / "out"))
    assert sorted(p.name for p in (tmp_path / "out").iterdir()) == ["one.txt", "two.txt"] and done.log.count() == 2
    assert [r["path"].rsplit("/", 1)[1] for r in as_dicts(done.skipped)] == ["notes.md"]
    assert as_dicts(done.collisions) == [{"basename": "one.txt", "paths": 2}]


def test_messages_to_files(spark, tmp_path):
    make_zip(tmp_path / "raw" / "day 1" / "a.zip", [("one.txt", b"1")])
    body = '{"Records": [{"s3": {"object": {"key": "%s"}}}]}'
    rows = [(body % "raw%2Fday+1/a.zip",), (body % "raw%2Fday+1/a.zip",), (body % "logs/x.zip",), (None,), ("{}",)]
    out = str(tmp_path / "out")
    for _ in range(2):
        done = jobs.unpack_messages(spark, spark.createDataFrame(rows, "body string"), str(tmp_path), out)
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["one.txt"] and (tmp_path / "out" / "one.txt").read_bytes() == b"1"
    assert [r["path"].rsplit("/", 2)[1:] for r in as_dicts(done.skipped)] == [["logs", "x.zip"]]


def test_unpacked_files_are_read_by_their_log(spark, landing, tmp_path):
    """Each once, empty ones too; one that is gone gives no row."""
    out = tmp_path / "out put"
    log = unpack_archives(archive_manifest(scan_archives(spark, str(landing))), str(out)).persist()
    assert log.count() == 3
    (out / "stray.txt").write_text("not in the log")
    read = unpacked_files(log.union(log))
    assert read.inputFiles() == log.inputFiles()
    content = {"one.txt": [b"ONE", b"one"], "two.txt": [b"two" * 1000], "empty.txt": [b""]}
    rows = as_dicts(read)
    assert len(rows) == 3 and all(bytes(r["content"]) in content[r["path"].rsplit("/", 1)[1]] for r in rows)
    (out / "two.txt").unlink()
    assert {r["path"].rsplit("/", 1)[1] for r in as_dicts(unpacked_files(log))} == {"one.txt", "empty.txt"}
    log.unpersist()


def test_messages_query_reads_what_it_unpacked_without_a_listing(spark, tmp_path):
    """No file that was unpacked is known to the driver; a document without text is unpacked like any other."""
    documents = [(i, "text %d" % i if i % 5 else "", "en", "s", 6) for i in range(70)]
    spark.createDataFrame(documents, TABLES["documents"]).coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, "u", "h")], TABLES["pages"]).write.parquet(f"{tmp_path}/pages.parquet")
    read = QUERIES["unpack_from_messages"].run(spark, f"file://{tmp_path}")
    assert not [f for f in read.inputFiles() if f.endswith(".txt")]
    assert {(r["filename"], r["md5"]) for r in as_dicts(read)} == {
        (f"doc-{no}.txt", hashlib.md5(text.encode()).hexdigest()) for no, text, *_ in documents}


def test_a_store_that_tasks_cannot_open(spark):
    with pytest.raises(RuntimeError, match="viewfs://x/y"):
        jobs.unpack_landing(spark, "viewfs://x/y", "/tmp/nowhere")


@pytest.mark.parametrize("method", [zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED, zipfile.ZIP_BZIP2, zipfile.ZIP_LZMA])
def test_crc_check_finds_damage(spark, tmp_path, method):
    path = make_zip(tmp_path / "raw" / "c.zip", [("bad", b"payload " * 50), ("good", b"fine")], method)
    content = bytearray(path.read_bytes())
    info = zipfile.ZipFile(io.BytesIO(bytes(content))).getinfo("bad")
    names = struct.unpack_from("<2H", content, info.header_offset + 26)
    content[info.header_offset + 30 + sum(names) + info.compress_size // 2] ^= 0x55
    path.write_bytes(bytes(content))
    checked = as_dicts(verify_member_crc(archive_manifest(scan_archives(spark, str(tmp_path)))))
    assert {r["filename"]: r["ok"] for r in checked} == {"bad": False, "good": True}


def test_unpack_flattens_and_last_archive_wins(spark, landing, tmp_path):
    os.utime(landing / "a.zip", (1_700_000_000, 1_700_000_000))
    os.utime(landing / "day2" / "b.zip", (1_700_000_100, 1_700_000_100))
    out = str(tmp_path / "processed")
    files = landed_archives(scan_archives(spark, str(landing)))
    log = as_dicts(unpack_archives(archive_manifest(files), out), "target")
    assert [r["target"].rsplit("/", 1)[1] for r in log] == ["empty.txt", "one.txt", "two.txt"]
    assert (tmp_path / "processed" / "one.txt").read_bytes() == b"ONE"
    assert sorted(p.name for p in (tmp_path / "processed").iterdir()) == ["empty.txt", "one.txt", "two.txt"]


def test_unpack_cannot_leave_the_folder(spark, tmp_path):
    make_zip(tmp_path / "raw" / "evil.zip", [("../../escape.txt", b"x"), ("/abs.txt", b"y")])
    unpack_archives(archive_manifest(scan_archives(spark, str(tmp_path / "raw"))), str(tmp_path / "processed")).collect()
    assert sorted(p.name for p in (tmp_path / "processed").iterdir()) == ["abs.txt", "escape.txt"]
    assert not (tmp_path / "escape.txt").exists()


def test_repeated_names_in_one_archive(spark, tmp_path):
    with pytest.warns(UserWarning):
        make_zip(tmp_path / "raw" / "d.zip", [("x.txt", b"1"), ("x.txt", b"2"), ("x.txt", b"3"), ("y.txt", b"4")])
    renamed = as_dicts(M.rename_duplicate_members(archive_manifest(scan_archives(spark, str(tmp_path)))), "member_no")
    assert [r["output_name"] for r in renamed] == ["x.txt", "x.txt_0", "x.txt_1", "y.txt"]
    unpack_archives(archive_manifest(scan_archives(spark, str(tmp_path / "raw"))), str(tmp_path / "out")).collect()
    assert {p.name: p.read_bytes() for p in (tmp_path / "out").iterdir()} == {
        "x.txt": b"1", "x.txt_0": b"2", "x.txt_1": b"3", "y.txt": b"4"}


PATHS = {
    "a/b.txt": "a/b.txt", "/abs/c": "abs/c", "//abs": "abs", "./d": "d", "a/../e": "e", "a/./f//g": "a/f/g",
    "../h": None, "a/../../i": None, "../zone/j": "j", "..": None, "": "", "a/..": "", "..hidden/k": "..hidden/k",
}


def test_unsafe_paths(spark):
    df = spark.createDataFrame([(p,) for p in PATHS], "filename string")
    rows = as_dicts(M.reject_unsafe_paths(df, root="/landing/zone"))
    assert {r["filename"]: r["safe_path"] for r in rows} == PATHS
    assert all(r["is_safe"] == (PATHS[r["filename"]] is not None) for r in rows)


def test_select_members(spark):
    df = spark.createDataFrame([("a/b",), ("a/bc",), ("c",)], "filename string")
    wanted = spark.createDataFrame([("a/b",), ("zz",)], "name string")
    assert M.select_members(df, ["a/b"]).count() == M.select_members(df, wanted).count() == 1
    assert M.select_members_recursive(df, ["a/b"]).count() == 2


def test_container_types(spark):
    rows = [(name, bytearray.fromhex(magic) + b"...") for name, magic in MAGIC_NUMBERS.items()]
    rows += [("unknown", bytearray(b"text")), ("unknown", bytearray()), (None, None)]
    df = spark.createDataFrame(rows, "want string, content binary")
    assert all(r["want"] == r["container_type"] for r in as_dicts(M.detect_container_type(df)))


def test_digests_and_copies(spark):
    df = spark.createDataFrame([(1, bytearray(b"x")), (2, bytearray(b"x")), (3, bytearray(b"y"))], "id int, content binary")
    rows = as_dicts(M.content_digests(df), "id")
    assert rows[0]["crc32"] == zlib.crc32(b"x") and rows[0]["md5"] == "9dd4e461268c8034f5c8564e155c67a6"
    assert set(rows[0]) == {"id", *digests(F.lit(b""))}
    copies = as_dicts(M.duplicate_content(df, "id"))
    assert [(r["first_id"], r["copies"]) for r in copies] == [(1, 2)]


@pytest.mark.parametrize("mode", ["GCM", "CBC", "ECB"])
def test_protect_and_reveal(spark, mode):
    df = spark.createDataFrame([("VIN1",), ("VIN1",), (None,), ("é",)], "vin string")
    hidden = M.protect_columns(df, ["vin"], b"0123456789abcdef", mode).cache()
    stored = [r["vin"] for r in hidden.collect()]
    assert stored[2] is None and "VIN1" not in stored
    assert (stored[0] == stored[1]) == (mode == "ECB")
    assert [r["vin"] for r in M.reveal_columns(hidden, ["vin"], b"0123456789abcdef", mode).collect()] == ["VIN1", "VIN1", None, "é"]


BODIES = [
    (1, None),
    (2, '{"Event": "s3:TestEvent"}'),
    (3, '{"Records": [{"s3": {"object": {}}}, {"s3": {}}, {}]}'),
    (4, '{"Records": [{"s3": {"object": {"key": "raw%2Fday+1%2Fa.zip"}}}, {"s3": {"object": {"key": "raw/b.txt"}}}]}'),
    (5, '{"Records": []}'),
    (6, '{"Records": [{"s3": {"object": {"key": "x/raw/c.7z", "size": 3}}, "awsRegion": "x"}]}'),
]


def test_envelopes(spark):
    df = spark.createDataFrame(BODIES, "id int, body string")
    keys = unpack_event_envelope(df)
    assert sorted((r["id"], r["key"]) for r in as_dicts(keys)) == [
        (4, "raw%2Fday+1%2Fa.zip"), (4, "raw/b.txt"), (6, "x/raw/c.7z")]
    assert sorted(r["key"] for r in as_dicts(filter_landing_keys(keys))) == ["raw/day 1/a.zip", "x/raw/c.7z"]


def test_malformed_envelope(spark):
    df = spark.createDataFrame([*BODIES, (7, "{not json")], "id int, body string")
    with pytest.raises(Exception):
        unpack_event_envelope(df).collect()
    assert unpack_event_envelope(df, strict=False).count() == 3


def test_filesystem_of_spark_paths():
    for uri in ("file:/a/b", "file:///a/b", "/a/b"):
        assert filesystem(uri)[1] == "/a/b"


def test_paths_get_a_scheme(spark):
    assert qualified(spark, "/a/b") == "file:/a/b"
    assert qualified(spark, "hdfs://host/a") == "hdfs://host/a" and qualified(spark, "file:/a") == "file:/a"


def test_work_paths_differ(spark):
    assert work_path(spark, "x") != work_path(spark, "x")
    assert work_path(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))


def test_damaged_member_fails_extraction(spark, tmp_path):
    path = make_zip(tmp_path / "raw" / "c.zip", [("bad", b"payload")], zipfile.ZIP_STORED)
    path.write_bytes(path.read_bytes().replace(b"payload", b"paYload", 1))
    with pytest.raises(Exception, match="bad checksum"):
        extract_archives(archive_manifest(scan_archives(spark, str(tmp_path)))).collect()


def test_members_are_read_without_the_directory(tmp_path):
    from voltrail.sources.containers import checked_chunks, open_archive

    path = make_zip(tmp_path / "c.zip", [("a", b"first"), ("b", b"second" * 9)])
    members = list(open_archive(str(path)).members())
    reader = open_archive(str(path))
    assert b"".join(checked_chunks(reader, members[1])) == b"second" * 9
    assert "archive" not in vars(reader)


def test_a_bomb_is_unpacked_in_pieces(tmp_path):
    from voltrail.sources.containers import open_archive

    path = make_zip(tmp_path / "c.zip", [("zeros", bytes(40 * 1024 * 1024))])
    reader = open_archive(str(path))
    sizes = [len(p) for p in reader.content(next(reader.members()))]
    assert sum(sizes) == 40 * 1024 * 1024 and max(sizes) <= CHUNK_BYTES


def test_a_failed_task_leaves_no_partial_file(spark, tmp_path):
    path = make_zip(tmp_path / "raw" / "c.zip", [("a.txt", b"whole"), ("b.txt", b"payload")], zipfile.ZIP_STORED)
    path.write_bytes(path.read_bytes().replace(b"payload", b"paYload", 1))
    with pytest.raises(Exception, match="bad checksum"):
        unpack_archives(archive_manifest(scan_archives(spark, str(tmp_path / "raw"))), str(tmp_path / "out")).collect()
    assert [p.name for p in (tmp_path / "out").iterdir()] == ["a.txt"]
