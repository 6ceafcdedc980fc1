"""Archives: round trips, records inside payloads, many splits."""

import base64
import hashlib

import pytest
from pyspark.sql import functions as F

from voltrail.llm import warc
from voltrail.session import work_path


def digest(payload):
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def expected(rows):
    last = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        last[payload] = max(last.get(payload, -1), page)
    out = {}
    for page, _, html in rows:
        payload = (html or "").encode()
        first = last[payload] == page
        out[page] = (len(payload), digest(payload), "response" if first else "revisit", None if first else last[payload])
    return out


def inner_archive(n):
    return "".join(
        f"WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:{900 + i}>\r\nContent-Length: 3\r\n\r\nabc\r\n\r\n"
        for i in range(n))


ROWS = [
    (1, "http://a/1", "<p>eins</p>"), (2, "http://a/2", "<p>eins</p>"), (3, None, None), (4, "http://a/4", ""),
    (5, "http://a/\r\nWARC/1.1\r\n5", "zwei"), (6, "http://a/6", inner_archive(4)),
    (7, "http://a/7", "x\r\n" + inner_archive(2) + "tail\nWARC/1.0\r\nContent-Length: 99999\r\n\r\n"),
    (8, "http://a/8", "WARC/1.1"), (9, "u", "ends in blank lines\r\n\r\n"), (10, "u", "größer – 多い\nWARC/1."),
    (11, "u", "long " * 50_000), (12, "u", inner_archive(1)[:-4]), (13, "u", inner_archive(4)),
]


def got(df):
    return {r["page_id"]: (r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"]) for r in df.collect()}


@pytest.mark.parametrize("split", ["128m", "2k"])
def test_round_trip(spark, split):
    pages = spark.createDataFrame(ROWS, "page_id long, url string, html string").withColumn("digest", F.lit(1))
    spark.conf.set("spark.sql.files.maxPartitionBytes", split)
    try:
        assert got(warc.warc_round_trip(pages.coalesce(1))) == expected(ROWS)
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_url_and_missing_id(spark):
    pages = spark.createDataFrame([(None, "http://x", "a"), (4, "http://y", "b")], "page_id long, url string, html string")
    path = work_path(spark, "test-warc")
    warc.write_warc(pages, path)
    rows = {r["url"]: r["page_id"] for r in warc.read_warc(spark, path).collect()}
    assert rows == {"http://x": None, "http://y": 4}


def test_a_file_without_a_record_at_its_start_gives_none(spark):
    path = work_path(spark, "test-warc")
    spark.createDataFrame([("junk\r\n\r\n" + inner_archive(2),)], "value string").coalesce(1).write.text(path)
    assert warc.read_warc(spark, path).count() == 0


def test_empty_table(spark):
    assert warc.warc_round_trip(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
