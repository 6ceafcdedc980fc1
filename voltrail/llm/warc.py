"""WARC archives: written by Spark's text writer, read back by verified record boundaries.

Reading never trusts the magic alone. Spark's text reader cuts the files at line starts that carry it, so a file of any
size is read by many tasks. Every cut is a candidate record; its header says where its successor starts. Only candidates
that the chain of successors from the start of the file reaches are records, so a payload may hold whole records of its
own. Runs of candidates that follow one another without a gap are one link of the chain; pointer jumping over the links
takes as many rounds as the logarithm of their number.

Defined results: null html is an empty payload, a null url is left out, a null page id is written as `null` and read
back as null. Rows repeated with the largest id of their payload are all responses. An empty table gives no record.
Extra columns are ignored. A file that does not start with a record, or bytes behind the last whole record, give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from voltrail.llm.common import base32
from voltrail.session import shuffles_freed, work_path, written

MAGIC = "WARC/1."
CUT = "\n" + MAGIC
END = "\r\n\r\n"
RECORD_ID = "urn:page:"
WRITE_ROUNDS = 2


def payload_digest(payload: Column) -> Column:
    return base32(F.sha1(payload))


def with_record_types(pages: DataFrame) -> DataFrame:
    """page_id, url, payload, digest, record_type, refers_to: equal payloads refer to the one with the largest id.

    The responses are one row per payload, made with a partial step before the shuffle and written, so that Spark can
    split the rows of a payload that a third of the pages share.
    """
    rows = pages.select("page_id", "url", F.encode(F.coalesce("html", F.lit("")), "UTF-8").alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload")))
    responses = written(rows.groupBy("digest").agg(F.max("page_id").alias("response")), "warc-responses")
    first = F.col("page_id").eqNullSafe(F.col("response"))
    return rows.join(responses, "digest").select(
        "page_id", "url", "payload", "digest",
        F.when(first, "response").otherwise("revisit").alias("record_type"),
        F.when(~first, F.col("response")).alias("refers_to"),
    )


def record_text(rows: DataFrame) -> Column:
    """One record without its closing blank lines; no header field can start a line with the magic."""
    page = F.coalesce(F.col("page_id").cast("string"), F.lit("null"))
    revisit = F.col("record_type") == "revisit"
    length = F.length("payload").cast("string")
    head = F.concat(
        F.lit("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=UTF-8\r\nContent-Length: "), length, F.lit(END)
    )
    block = F.concat(F.encode(head, "UTF-8"), F.when(revisit, F.lit(b"")).otherwise(F.col("payload")))
    url = F.regexp_replace(F.regexp_replace("url", "\r", "%0D"), "\n", "%0A")
    fields = F.concat(
        F.lit("WARC/1.1\r\nWARC-Type: "), F.col("record_type"),
        F.lit(f"\r\nWARC-Record-ID: <{RECORD_ID}"), page,
        F.coalesce(F.concat(F.lit(">\r\nWARC-Target-URI: "), url), F.lit(">")),
        F.lit("\r\nWARC-Date: 2024-01-01T00:00:00Z\r\nWARC-Payload-Digest: sha1:"), F.col("digest"),
        F.when(revisit, F.concat(
            F.lit(f"\r\nWARC-Refers-To: <{RECORD_ID}"), F.coalesce(F.col("refers_to").cast("string"), F.lit("null")),
            F.lit(">\r\nWARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"),
        )).otherwise(""),
        F.lit("\r\nContent-Type: application/http; msgtype=response\r\nContent-Length: "),
        F.length(block).cast("string"), F.lit(END),
    )
    return F.concat(F.encode(fields, "UTF-8"), block).cast("string")


def write_warc(pages: DataFrame, path: str, rounds: int = WRITE_ROUNDS) -> None:
    """One record per page; Spark's commit protocol makes each file whole or absent.

    Payloads meet their record type by a shuffle. They are written in `rounds`, each with its share of the digests,
    so the shuffle takes a share of the disk only.
    """
    rows = with_record_types(pages)
    for number in range(rounds):
        own = rows.where(F.pmod(F.xxhash64("digest"), F.lit(rounds)) == number)
        with shuffles_freed(pages.sparkSession):
            own.select(record_text(own).alias("value")).write.mode("append").option("lineSep", END).text(path)


def _field(name: str, header: Column) -> Column:
    """A header field's value, null where it is missing."""
    found = F.regexp_extract(header, rf"(?im)^{name}:[ \t]*([^\r\n]*?)[ \t]*\r?$", 1)
    return F.when(found != "", found)


def pieces(spark: SparkSession, path: str) -> DataFrame:
    """The files cut at line starts that carry the magic: file, split, seq (order within a split), value."""
    return spark.read.option("lineSep", CUT).text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("split"),
        F.monotonically_increasing_id().alias("seq"), "value",
    )


def _placed(cut: DataFrame) -> DataFrame:
    """Pieces with `at`, where their text starts, and `offset`, where their record would start.

    Positions are running sums: within a split over its pieces, then over the splits of a file. Behind a cut a piece
    lacks the magic; the first piece of a file still has it.
    """
    step = F.col("bytes") + len(CUT)
    totals = cut.groupBy("file", "split").agg(F.sum(step).alias("total"))
    earlier = Window.partitionBy("file").orderBy("split").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select("file", "split", F.coalesce(F.sum("total").over(earlier), F.lit(0)).alias("base"))
    in_split = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    shift = F.coalesce(F.sum(step).over(in_split), F.lit(0))
    placed = cut.withColumn("shift", shift).join(starts, ["file", "split"])
    placed = placed.withColumn("at", F.col("base") + F.col("shift")).drop("base", "shift")
    return placed.withColumn("offset", F.when(F.col("at") == 0, F.lit(0)).otherwise(F.col("at") - len(MAGIC)))


def candidates(spark: SparkSession, path: str) -> DataFrame:
    """Every cut with its offset, and for those that look like records their successor and digest. No payload moves."""
    header = F.substring_index(F.col("value"), END, 1)
    body = F.col("value").cast("binary")
    cut = pieces(spark, path).select(
        "file", "split", "seq", F.octet_length("value").cast("long").alias("bytes"),
        header.alias("header"), (F.instr("value", END) > 0).alias("has_header"), body.alias("body"),
    )
    block = _field("Content-Length", F.col("header")).cast("long")
    head_bytes = F.octet_length("header").cast("long") + 4
    inside = F.substring("body", (head_bytes + 1).cast("int"), block.cast("int"))
    http_bytes = F.octet_length(F.substring_index(inside.cast("string"), END, 1)).cast("long") + 4
    payload = F.substring(inside, (http_bytes + 1).cast("int"), F.octet_length(inside))
    whole = head_bytes + block <= F.col("bytes")
    rows = cut.select(
        "file", "split", "seq", "bytes", F.when(F.col("has_header"), F.col("header")).alias("header"),
        F.when(F.col("has_header"), head_bytes).alias("head_bytes"),
        F.when(F.col("has_header"), block).alias("block_bytes"),
        F.when(whole, payload_digest(payload)).alias("found_digest"),
        F.when(whole, F.octet_length(payload).cast("long")).alias("found_bytes"),
        F.when(whole, _field("Content-Length", F.substring_index(inside.cast("string"), END, 1)).cast("long"))
        .alias("http_bytes"),
    )
    rows = written(rows, "warc-pieces")
    at = F.col("at")
    looks = F.col("header").isNotNull() & F.col("block_bytes").isNotNull() & F.when(
        at == 0, F.col("header").rlike(r"^WARC/1\.[01]\r\n")
    ).otherwise(F.col("header").rlike(r"^[01]\r\n"))
    out = _placed(rows).select(
        "file", "split", "seq", "header", "head_bytes", "block_bytes", "found_digest", "found_bytes", "http_bytes",
        "offset", F.when(looks, at + F.col("head_bytes") + F.col("block_bytes") + 4).alias("next"),
    )
    return written(out, "warc-candidates")


def reachable(found: DataFrame) -> DataFrame:
    """file, offset of the candidates on the chain from the start of their file.

    A link is a run of candidates of which each is the next one's predecessor; a run also ends where another candidate
    jumps to. Links that the chain can reach double their distance each round.
    """
    spark = found.sparkSession
    edges = found.where("next IS NOT NULL").select("file", "split", "offset", "next")
    in_split = Window.partitionBy("file", "split").orderBy("offset")
    edges = edges.withColumn("follows", F.lag("next").over(in_split).eqNullSafe(F.col("offset"))) \
                 .withColumn("leads", F.lead("offset").over(in_split).eqNullSafe(F.col("next")))
    jumps = edges.where(~F.col("leads")).select("file", F.col("next").alias("offset")).distinct()
    marked = edges.join(jumps.withColumn("entered", F.lit(True)), ["file", "offset"], "left")
    head = ~F.col("follows") | F.coalesce("entered", F.lit(False))
    runs = marked.withColumn("link", F.max(F.when(head, F.col("offset"))).over(
        in_split.rowsBetween(Window.unboundedPreceding, 0)))
    runs = written(runs.select("file", "offset", "next", "link"), "warc-runs")
    links = written(
        runs.groupBy("file", "link").agg(F.max("next").alias("to"), F.max("offset").alias("last")), "warc-links"
    )
    known = links.select("file", F.col("link").alias("to"))
    hop = written(links.select("file", "link", "to").join(known, ["file", "to"], "left_semi"), "warc-hops")
    reached = written(links.where("link = 0").select("file", "link"), "warc-reached")
    while not hop.isEmpty():
        more = reached.join(hop, ["file", "link"]).select("file", F.col("to").alias("link"))
        reached = written(reached.union(more).distinct(), "warc-reached")
        onward = hop.select("file", F.col("link").alias("to"), F.col("to").alias("beyond"))
        hop = written(hop.join(onward, ["file", "to"]).select("file", "link", F.col("beyond").alias("to")), "warc-hops")
    return runs.join(reached, ["file", "link"], "left_semi").select("file", "offset")


def read_warc(spark: SparkSession, path: str) -> DataFrame:
    """One row per verified record: file, offset, record_type, page_id, url, payload_bytes, payload_digest, refers_to.

    A response's digest and length are those of the bytes in the archive. Records whose payload holds the magic at a
    line start lie in several pieces; only those are read a second time and put together.
    """
    found = candidates(spark, path)
    chain = written(reachable(found), "warc-chain")
    records = found.join(chain, ["file", "offset"])
    whole = records.where("found_digest IS NOT NULL").withColumn("split_bytes", F.lit(None).cast("long"))
    torn = records.where("found_digest IS NULL").select(
        "file", "offset", "next", "header", "head_bytes", "block_bytes"
    )
    if not torn.isEmpty():
        joined = _put_together(spark, path, found, chain, torn)
        whole = whole.unionByName(joined, allowMissingColumns=True)
    revisit = F.col("record_type") == "revisit"
    return whole.select(
        "file", "offset", F.lower(_field("WARC-Type", F.col("header"))).alias("record_type"), "header",
        "found_digest", "found_bytes", "http_bytes",
    ).select(
        "file", "offset", "record_type", _id("WARC-Record-ID").alias("page_id"),
        _field("WARC-Target-URI", F.col("header")).alias("url"),
        F.when(revisit, F.col("http_bytes")).otherwise(F.col("found_bytes")).alias("payload_bytes"),
        F.when(revisit, F.regexp_replace(_field("WARC-Payload-Digest", F.col("header")), "^sha1:", ""))
        .otherwise(F.col("found_digest")).alias("payload_digest"),
        F.when(revisit, _id("WARC-Refers-To")).alias("refers_to"),
    )


def _id(name: str) -> Column:
    return F.regexp_extract(_field(name, F.col("header")), RECORD_ID + "([0-9-]+)", 1).try_cast("long")


def _put_together(spark: SparkSession, path: str, found: DataFrame, chain: DataFrame, torn: DataFrame) -> DataFrame:
    """Torn records with digest and lengths: their pieces, each owned by the last record at or before it.

    The second reading places its pieces anew, so it needs no order or split in common with the first.
    """
    flagged = found.select("file", "split", "seq", "offset").join(
        chain.withColumn("start", F.col("offset")), ["file", "offset"], "left")
    in_split = Window.partitionBy("file", "split").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    flagged = flagged.withColumn("own", F.max("start").over(in_split))
    carried = flagged.groupBy("file", "split").agg(F.max("start").alias("latest")).withColumn(
        "carry", F.max("latest").over(Window.partitionBy("file").orderBy("split").rowsBetween(
            Window.unboundedPreceding, -1))).select("file", "split", "carry")
    owned = flagged.join(carried, ["file", "split"]).select(
        "file", "offset", F.coalesce("own", "carry").alias("record"))
    wanted = written(
        owned.join(torn.select("file", F.col("offset").alias("record")), ["file", "record"], "left_semi"), "warc-torn")
    again = pieces(spark, path).join(torn.select("file").distinct(), "file", "left_semi")
    again = _placed(again.withColumn("bytes", F.octet_length("value").cast("long")))
    parts = again.select("file", "offset", "value").join(wanted, ["file", "offset"])
    content = parts.groupBy("file", "record").agg(
        F.sort_array(F.collect_list(F.struct("offset", F.col("value").cast("binary").alias("value")))).alias("parts")
    ).select(
        "file", F.col("record").alias("offset"),
        F.expr(f"aggregate(slice(parts, 2, size(parts)), parts[0].value, (a, p) -> concat(a, X'{CUT.encode().hex()}', p.value))")
        .alias("body"),
    )
    inside = F.expr("substring(body, cast(head_bytes + 1 as int), cast(block_bytes as int))")
    http = F.substring_index(F.col("inside").cast("string"), END, 1)
    payload = F.expr("substring(inside, cast(http_len + 1 as int), octet_length(inside))")
    return torn.join(content, ["file", "offset"]).withColumn("inside", inside) \
        .where(F.octet_length("inside") == F.col("block_bytes")) \
        .withColumn("http_len", F.octet_length(http) + 4).withColumn("payload", payload).select(
            "file", "offset", "header", payload_digest(F.col("payload")).alias("found_digest"),
            F.octet_length("payload").cast("long").alias("found_bytes"),
            _field("Content-Length", http).cast("long").alias("http_bytes"))


def warc_round_trip(pages: DataFrame) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to as the archives of these pages say."""
    spark = pages.sparkSession
    path = work_path(spark, "warc")
    write_warc(pages, path)
    return read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


SQL = """WITH p AS (
  SELECT page_id, coalesce(html, '') AS html FROM pages),
d AS (
  SELECT page_id, CAST(strlen(html) AS BIGINT) AS payload_bytes, sha1(html) AS h, max(page_id) OVER (PARTITION BY html) AS first
  FROM p)
SELECT page_id, payload_bytes,
       array_to_string(list_transform(range(32), lambda i:
         ('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567')[1 + ((('0x' || h[(i // 8) * 10 + 1 : (i // 8) * 10 + 10])::BIGINT
           >> (5 * (7 - i % 8))) & 31)]), '') AS payload_digest,
       CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN page_id <> first THEN first END AS refers_to
FROM d"""
