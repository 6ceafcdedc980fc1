"""Reversible line de-duplication: sharded cuckoo filters in front of exact reference counts.

A `LineIndex` holds which document refers to which line key, how often each key is referred to, and one cuckoo filter
per shard of keys. A batch asks the filters first: a key that they do not know is new and needs no look at the counts;
only possible old ones meet the exact table. Deleting documents lowers the counts, takes keys at zero out of the filters
and leaves the index as if the documents had never been there. What a step changes is written, so it can be repeated.
`dedup_lines` deals the documents to `BATCHES` batches, by a hash of the id, and inserts one after the other.

A key is the line without white space at both ends and with A-Z lower-cased, known by its MD5. Keys of at least
`min_chars` code points in at least `min_docs` documents lose their lines except in the largest doc_id that holds them.

Defined results: null or empty text is one empty line. A null id counts as one document, smaller than all others. Rows
repeated with one id are one document for the counts, and each row keeps or loses its lines alike. Extra columns are
ignored. An empty table gives no rows. Lines of any length are hashed whole.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, replace

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from voltrail.llm import cuckoo, slices
from voltrail.llm.common import SPACE, ascii_lower
from voltrail.llm.cuckoo import CuckooFilter
from voltrail.llm.slices import by_slices
from voltrail.session import send_to_tasks, work_folders_removed, written

MIN_CHARS, MIN_DOCS = 40, 5
SHARD_KEYS = 500_000
BATCHES = 4
FILTERS = "shard int, filter binary"
NO_ID = -(2**63)
SPLIT = pa.struct([("kept", pa.string()), ("n_lines", pa.int64()), ("n_dropped", pa.int64())])


def line_key(line: Column) -> Column:
    return ascii_lower(F.regexp_replace(line, rf"^[{SPACE}]+|[{SPACE}]+\z", ""))


def line_refs(docs: DataFrame, min_chars: int = MIN_CHARS) -> DataFrame:
    """doc_id, key: each document's distinct line keys of at least `min_chars` code points."""
    lines = docs.select("doc_id", F.explode(F.split(F.coalesce("text", F.lit("")), "\n", -1)).alias("line"))
    # A key is no longer than its line.
    keys = lines.where(F.length("line") >= min_chars).select(
        F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id"), line_key(F.col("line")).alias("line"))
    return keys.where(F.length("line") >= min_chars).select("doc_id", F.unhex(F.md5("line")).alias("key")).distinct()


def _short(key: Column) -> Column:
    """The key's first 60 bits, for shards and filters."""
    return F.conv(F.substring(F.hex(key), 1, 15), 16, 10).cast("long")


def _count(refs: DataFrame) -> DataFrame:
    return refs.groupBy("key").agg(F.count(F.lit(1)).alias("docs"), F.max("doc_id").alias("last_doc"))


def _build(group: pd.DataFrame, room: int) -> pd.DataFrame:
    held = CuckooFilter.build(group["short"].to_numpy(), room)
    return pd.DataFrame({"shard": [int(group["shard"].iloc[0])], "filter": [held.to_bytes()]})


def _ask(batch: pd.DataFrame, filters: pd.DataFrame) -> pd.DataFrame:
    """The batch's keys with `maybe`: whether the shard's filter may hold them."""
    if len(filters):
        maybe = CuckooFilter.from_bytes(filters["filter"].iloc[0]).contains(batch["short"].to_numpy())
    else:
        maybe = np.zeros(len(batch), bool)
    return batch[["key", "docs", "last_doc"]].assign(maybe=maybe)


def _change(keys: pd.DataFrame, filters: pd.DataFrame, gone: bool, room: int) -> pd.DataFrame:
    """A shard's filter after keys went or came; null if it has no place for them."""
    if not len(keys):
        return filters[["shard", "filter"]]
    short, held = keys["short"].to_numpy(), None
    if not len(filters):
        held = CuckooFilter.build(short, room)
    else:
        held = CuckooFilter.from_bytes(filters["filter"].iloc[0])
        if gone:
            held.delete(short)
        elif len(held.insert(short)):
            held = None
    return pd.DataFrame({"shard": [int(keys["shard"].iloc[0])], "filter": [held and held.to_bytes()]})


@dataclass(frozen=True)
class LineIndex:
    """refs: doc_id, key. counts: key, docs, last_doc. filters: a row per shard.

    A shard is `short % shards`. Shards split by twos, before a batch comes, so that none has more than about `shard_keys`
    keys; the keys for the new filters come from the exact counts.
    """

    refs: DataFrame
    counts: DataFrame
    filters: DataFrame
    shards: int
    shard_keys: int = SHARD_KEYS

    @classmethod
    def of(cls, refs: DataFrame, shard_keys: int = SHARD_KEYS) -> "LineIndex":
        """An index of a first batch: there is nothing to ask yet."""
        return cls._first(written(refs, "line-refs"), shard_keys)

    @classmethod
    def loaded(cls, refs: DataFrame, batches: int = BATCHES, shard_keys: int = SHARD_KEYS) -> "LineIndex":
        """An index of many documents, a batch after the other; each asks the filters of those before it."""
        dealt = written(refs.withColumn("batch", F.pmod(F.xxhash64("doc_id"), F.lit(batches))), "line-refs")
        index = cls._first(dealt.where("batch = 0").drop("batch"), shard_keys)
        for nr in range(1, batches):
            index = index.insert(dealt.where(F.col("batch") == nr).drop("batch"), repeats=False)
        return replace(index, refs=dealt.drop("batch"))

    @classmethod
    def _first(cls, refs: DataFrame, shard_keys: int) -> "LineIndex":
        for module in (__name__, cuckoo.__name__, slices.__name__):
            send_to_tasks(module)
        none = refs.sparkSession.createDataFrame([], FILTERS)
        return cls(refs, written(_count(refs), "line-counts"), none, 0, shard_keys)._with_room(0)

    def _sharded(self, keys: DataFrame) -> DataFrame:
        return keys.withColumn("short", _short(F.col("key"))).withColumn(
            "shard", (F.col("short") % self.shards).cast("int"))

    @property
    def _room(self) -> int:
        return self.shard_keys + self.shard_keys // 4

    def _built(self, shards: int) -> "LineIndex":
        """The index with filters made anew, in so many shards."""
        index, room = replace(self, shards=shards), self._room
        filters = index._sharded(self.counts.select("key")).drop("key").groupBy("shard").applyInPandas(
            lambda group: _build(group, room), FILTERS)
        return replace(index, filters=written(filters, "line-filters"))

    def _with_room(self, more: int) -> "LineIndex":
        """The index with shards for `more` further keys."""
        need = max(1, -(-(self.counts.count() + more) // self.shard_keys))
        return self if need <= self.shards else self._built(1 << (need - 1).bit_length())

    def _asked(self, counts: DataFrame) -> DataFrame:
        """A batch's counts with `maybe`, answered by each key's shard."""
        ask = _ask
        asked = self._sharded(counts).groupBy("shard").cogroup(self.filters.groupBy("shard"))
        return written(
            asked.applyInPandas(
                lambda batch, filters: ask(batch, filters), "key binary, docs long, last_doc long, maybe boolean"),
            "line-asked")

    def _told(self, keys: DataFrame, gone: bool) -> "LineIndex":
        """The index after its filters learned of new or gone keys; filters of other shards stay as they are."""
        room, keys = self._room, written(self._sharded(keys).drop("key"), "line-changed")
        shards = keys.select("shard").distinct()
        changed = written(
            keys.groupBy("shard").cogroup(self.filters.join(shards, "shard", "left_semi").groupBy("shard"))
            .applyInPandas(lambda keys, filters: _change(keys, filters, gone, room), FILTERS), "line-filters")
        if not changed.where("filter IS NULL").isEmpty():
            return self._built(self.shards)
        return replace(self, filters=self.filters.join(shards, "shard", "left_anti").unionByName(changed))

    def insert(self, refs: DataFrame, repeats: bool = True) -> "LineIndex":
        """The index with a further batch.

        Keys that the filters don't know are new and are added without a look at the counts; only the others meet them.
        References that the index already holds change nothing; `repeats` tells whether the batch may have such.
        """
        fresh = written(refs.join(self.refs, ["doc_id", "key"], "left_anti"), "line-refs") if repeats else refs
        batch = written(_count(fresh), "line-counts")
        index = self._with_room(batch.count())
        asked = index._asked(batch)
        maybe = asked.where("maybe").select("key", F.col("docs").alias("more"), F.col("last_doc").alias("later"))
        met = index.counts.join(maybe, "key", "full").select(
            "key", (F.coalesce("docs", F.lit(0)) + F.coalesce("more", F.lit(0))).alias("docs"),
            F.greatest("last_doc", "later").alias("last_doc"), F.col("docs").isNull().alias("new"))
        unknown = asked.where(~F.col("maybe")).select("key", "docs", "last_doc", F.lit(True).alias("new"))
        counts = written(met.unionByName(unknown), "line-counts")
        index = replace(index, refs=index.refs.unionByName(fresh), counts=counts.drop("new"))
        return index._told(counts.where("new").select("key"), gone=False)

    def delete(self, doc_ids: DataFrame) -> "LineIndex":
        """The index without these documents: as it was before they came.

        Only the counts of the documents' own keys change, by subtraction; the latest document is sought again only for
        keys that lose it. Nothing else is written again.
        """
        ids = written(doc_ids.select(F.coalesce("doc_id", F.lit(NO_ID)).alias("doc_id")).distinct(), "line-gone")
        gone = written(self.refs.join(ids, "doc_id", "left_semi"), "line-refs")
        refs = self.refs.join(ids, "doc_id", "left_anti")
        lost = gone.groupBy("key").agg(F.count(F.lit(1)).alias("less"), F.max("doc_id").alias("top"))
        less = written(self.counts.join(lost, "key").select(
            "key", (F.col("docs") - F.col("less")).alias("docs"), "last_doc", (F.col("top") == F.col("last_doc")).alias("bare")),
            "line-less")
        headless = less.where("bare AND docs > 0").select("key")
        heads = refs.join(headless, "key", "left_semi").groupBy("key").agg(F.max("doc_id").alias("head"))
        changed = written(less.join(heads, "key", "left").select(
            "key", "docs", F.coalesce("head", "last_doc").alias("last_doc")), "line-counts")
        counts = self.counts.join(changed.select("key"), "key", "left_anti").unionByName(changed.where("docs > 0"))
        index = replace(self, refs=refs, counts=counts)
        return index._told(changed.where("docs = 0").select("key"), gone=True)

    def repeated(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """key, last_doc of the keys that lose lines."""
        return self.counts.where(F.col("docs") >= min_docs).select("key", "last_doc")

    def drops(self, min_docs: int = MIN_DOCS) -> DataFrame:
        """doc_id, keys: what each document loses."""
        lost = written(self.repeated(min_docs), "line-repeated")
        return self.refs.join(lost, "key").where(F.col("doc_id") != F.col("last_doc")).groupBy("doc_id").agg(
            F.collect_list("key").alias("keys"))


def _strip(line: str) -> str:
    return line.strip(" \t\n\x0b\x0c\r")


def split_lines(text: str, keys: set[bytes], min_chars: int) -> tuple[str, int, int]:
    """The kept lines, joined; the number of lines and of those dropped."""
    lines = text.split("\n")
    if not keys:
        return text, len(lines), 0
    kept = [
        line for line in lines
        if len(line) < min_chars or hashlib.md5(_strip(line).encode().lower()).digest() not in keys
    ]
    return "\n".join(kept), len(lines), len(lines) - len(kept)


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS) -> DataFrame:
    """The rows of `docs` (all columns) with `kept` text, n_lines and n_dropped under `line_result`."""
    with work_folders_removed(docs.sparkSession) as kept:
        drops = kept(written(LineIndex.loaded(line_refs(docs, min_chars)).drops(min_docs), "line-drops"))

    def split(texts: list[str | None], keys: list[list[bytes] | None]) -> list[tuple[str, int, int]]:
        return [split_lines(t or "", set(k or ()), min_chars) for t, k in zip(texts, keys)]

    @F.arrow_udf("struct<kept:string,n_lines:long,n_dropped:long>")
    def apply(texts: pa.Array, keys: pa.Array) -> pa.Array:
        return by_slices(split, SPLIT, texts, keys)

    own = docs.columns
    marked = docs.withColumn("_line_doc", F.coalesce("doc_id", F.lit(NO_ID)))
    # What documents lose grows with them, so it is never sent to all tasks.
    lost = drops.select(F.col("doc_id").alias("_line_doc"), F.col("keys").alias("_line_keys")).hint("merge")
    joined = marked.join(lost, "_line_doc", "left")
    return joined.select(*own, apply(F.col("text"), F.col("_line_keys")).alias("line_result"))


def line_digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_lines, n_dropped, kept_sha256."""
    done = dedup_lines(docs.select("doc_id", "text"))
    return done.select(
        "doc_id", "line_result.n_lines", "line_result.n_dropped",
        F.sha2(F.encode("line_result.kept", "UTF-8"), 256).alias("kept_sha256"))


SQL = f"""WITH docs AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
lines AS (
  SELECT r, doc_id, generate_subscripts(s, 1) AS nr, unnest(s) AS line
  FROM (SELECT *, string_split(text, chr(10)) AS s FROM docs)),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^[\\x20\\x09-\\x0D]+|[\\x20\\x09-\\x0D]+$', '', 'g'),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
lost AS (
  SELECT key, max(coalesce(doc_id, {NO_ID})) AS last_doc FROM keyed WHERE length(key) >= {MIN_CHARS}
  GROUP BY key HAVING count(DISTINCT coalesce(doc_id, {NO_ID})) >= {MIN_DOCS})
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY nr) FILTER (NOT dropped), '')) AS kept_sha256
FROM (SELECT k.*, last_doc IS NOT NULL AND coalesce(doc_id, {NO_ID}) <> last_doc AS dropped
      FROM keyed k LEFT JOIN lost USING (key)) GROUP BY r"""
