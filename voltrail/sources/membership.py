"""Which readings a table holds, without reading the table.

Below the table's folder an index keeps, per batch that was added:

    _keys/of-<buckets>/<writer>/keys       day, bucket, identity of each reading, in that order
    _keys/of-<buckets>/<writer>/sketches   day, bucket, rows and a bitmap: a Bloom filter of the bucket's identities

A reading's bucket is a hash of its identity. A batch looks at the sketches of its days only. Readings that no sketch may
hold are new and are compared with nothing; for the others the keys of their days and buckets are read, and no others, as
the files are ordered by day and bucket. Sketches merge by `or`, so batches fold into one like all streamed results.

A bitmap has 32,768 places and a reading sets four of them: with 2,000 readings in a bucket about two in a thousand new
readings meet a full set of places. More readings to a bucket make a batch read more keys and change no result; choose
`buckets` as one per 2,000 readings of a day (the default suits days of a hundred thousand). Another number of buckets is
another index, built once from the table.

The index of a batch is written before its readings. A batch that is run again ignores what it wrote to the index, but
for keys that the table turns out to hold: so readings are neither lost nor doubled, wherever the first run ended.
"""

from __future__ import annotations

from typing import NamedTuple

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from voltrail.functions.signals import date_of
from voltrail.operators.dedup import IDENTITY, one_per_identity, row_identity
from voltrail.schema import READINGS_COLUMNS, READINGS_SCHEMA
from voltrail.session import make_folder, path_exists, subfolders, written
from voltrail.sources.readings import no_rows
from voltrail.sources.tables import DAY, append_counted, read_days, read_table, with_day
from voltrail.streaming.incremental import batch_path, compact_batches, read_batches

BUCKETS = 64
PLACES, HASHES = 32_768, 4
NO_DAY = -(2**31)
#: Beyond this number of suspected buckets whole days are read.
MOST_NAMED = 2_000

KEYS = f"day int, bucket int, {IDENTITY} string"
SKETCHES = "day int, bucket int, rows long, bitmap binary"


def _typed(df: DataFrame) -> DataFrame:
    """In the table's types and order, as identities of readings without a key are made of all columns."""
    rows = with_day(df).drop(DAY)
    known = [c for c in READINGS_COLUMNS if c in rows.columns]
    return rows.select(*known, *[c for c in rows.columns if c not in known])


def located(df: DataFrame, buckets: int) -> DataFrame:
    """The rows, which have an identity, with `day` (days since 1970, `NO_DAY` for none) and `bucket`."""
    return df.withColumns({
        "day": F.coalesce(F.unix_date(date_of()), F.lit(NO_DAY)),
        "bucket": F.pmod(F.xxhash64(IDENTITY), F.lit(buckets)).cast("int"),
    })


def _places() -> list[Column]:
    return [F.pmod(F.xxhash64(F.lit(salt), IDENTITY), F.lit(PLACES)) for salt in range(1, HASHES + 1)]


def sketches_of(keys: DataFrame) -> DataFrame:
    each = keys.select("day", "bucket", F.explode(F.array(*_places())).alias("place"))
    return each.groupBy("day", "bucket").agg(
        (F.count(F.lit(1)) / HASHES).cast("long").alias("rows"), F.bitmap_construct_agg("place").alias("bitmap"))


def merge_sketches(sketches: DataFrame) -> DataFrame:
    return sketches.groupBy("day", "bucket").agg(
        F.sum("rows").alias("rows"), F.bitmap_or_agg("bitmap").alias("bitmap"))


def _is_set(place: Column) -> Column:
    byte = F.substring(F.col("bitmap"), F.floor(place / 8).cast("int") + 1, F.lit(1))
    return F.getbit(F.conv(F.hex(byte), 16, 10).cast("int"), (place % 8).cast("int")) == 1


def ask(keys: DataFrame, sketches: DataFrame) -> DataFrame:
    """The rows of `keys` with `maybe`: whether a sketch may hold their identity."""
    every = F.lit(True)
    for place in _places():
        every = every & _is_set(place)
    merged = merge_sketches(sketches).select("day", "bucket", "bitmap")
    return keys.join(merged, ["day", "bucket"], "left").withColumn(
        "maybe", F.coalesce(F.col("bitmap").isNotNull() & every, F.lit(False))).drop("bitmap")


class KeyIndex:
    """The index of the table at `table_path`, as its writer `writer` sees it."""

    def __init__(self, spark: SparkSession, table_path: str, writer: str, buckets: int = BUCKETS):
        self.spark, self.table_path, self.writer, self.buckets = spark, table_path, writer, buckets
        self.folder = f"{table_path.rstrip('/')}/_keys/of-{buckets}"

    def _like(self, kind: str) -> DataFrame:
        return no_rows(self.spark, KEYS if kind == "keys" else SKETCHES)

    def _out(self, kind: str, writer: str | None = None) -> str:
        return f"{self.folder}/{writer or self.writer}/{kind}"

    def _read(self, kind: str, days: list[int], before: int | None) -> DataFrame:
        """All writers' rows on these days, of this writer only of batches earlier than `before`."""
        rows = self._like(kind)
        for writer in self.writers():
            own = read_batches(self._like(kind), self._out(kind, writer))
            if writer == self.writer and before is not None:
                own = own.where(F.col("batch_id") < before)
            rows = rows.unionByName(own.drop("batch_id"))
        return rows.where(F.col("day").isin(days))

    def writers(self) -> list[str]:
        return [name for name in subfolders(self.spark, self.folder) if name != "ready"]

    def sketches(self, days: list[int], before: int | None = None) -> DataFrame:
        return self._read("sketches", days, before)

    def keys(self, days: list[int], buckets: list[int], before: int | None = None) -> DataFrame:
        rows = self._read("keys", days, before)
        return rows.where(F.col("bucket").isin(buckets)) if len(buckets) <= MOST_NAMED else rows

    def began(self, batch_id: int) -> bool:
        return path_exists(self.spark, batch_path(self._out("keys"), batch_id))

    def of_batch(self, batch_id: int) -> DataFrame:
        return self.spark.read.schema(KEYS).parquet(batch_path(self._out("keys"), batch_id))

    def _write(self, keys: DataFrame, path_of) -> None:
        order = ["day", "bucket"]
        keys.select(*order, IDENTITY).repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").parquet(path_of("keys"))
        sketches_of(keys).write.mode("overwrite").parquet(path_of("sketches"))

    def write(self, keys: DataFrame, batch_id: int) -> None:
        self._write(keys, lambda kind: batch_path(self._out(kind), batch_id))

    def prepare(self) -> None:
        """Index what the table holds already, once."""
        if path_exists(self.spark, f"{self.folder}/ready"):
            return
        if path_exists(self.spark, self.table_path):
            rows = _typed(read_table(self.spark, self.table_path))
            found = located(rows.select("ts", row_identity(rows).alias(IDENTITY)), self.buckets)
            self._write(found, lambda kind: f"{self._out(kind, 'table')}/compacted/batch_id=-1")
        make_folder(self.spark, f"{self.folder}/ready")

    def compact(self, **options) -> int | None:
        """Fold this writer's batches into one; may run beside it."""
        order = ["day", "bucket"]
        compact_batches(
            self._like("keys"), self._out("keys"),
            lambda keys: keys.repartitionByRange(*order).sortWithinPartitions(*order), **options)
        return compact_batches(self._like("sketches"), self._out("sketches"), merge_sketches, **options)


class Added(NamedTuple):
    """rows: how many readings were added. before: how many the touched days held. days: those days, if any was added."""

    rows: int
    before: int
    days: list


def add_new_readings(
    incoming: DataFrame, table_path: str, batch_id: int, writer: str, buckets: int = BUCKETS
) -> Added:
    """Append the readings that the table lacks, each once; the same batch may run again.

    The counts come with the write and from the sketches: no reading is read for them.
    """
    spark = incoming.sparkSession
    index = KeyIndex(spark, table_path, writer, buckets)
    index.prepare()
    once = located(one_per_identity(_typed(incoming)), buckets).persist(StorageLevel.MEMORY_AND_DISK)
    asked = once
    try:
        touched = [(r.day, r.of) for r in once.select("day", date_of().alias("of")).distinct().collect()]
        days = [day for day, _ in touched]
        if not days:
            return Added(0, 0, [])
        sketches, kept = index.sketches(days, batch_id), None
        if not index.writers():
            fresh = once.withColumn("maybe", F.lit(False))
        else:
            asked = ask(once, sketches).persist(StorageLevel.MEMORY_AND_DISK)
            suspected = [r.bucket for r in asked.where("maybe").select("bucket").distinct().collect()]
            known = index.keys(days, suspected, batch_id).select(IDENTITY)
            fresh = asked.where("NOT maybe").unionByName(
                asked.where("maybe").join(known.distinct(), IDENTITY, "left_anti").select(asked.columns))
        if index.began(batch_id):
            kept = _in_table(index, batch_id)
            fresh = fresh.join(kept.select(IDENTITY).distinct(), IDENTITY, "left_anti")
        fresh = written(fresh.drop("maybe"), "fresh-readings")
        keys = fresh.select("day", "bucket", IDENTITY)
        before = sketches.groupBy().agg(F.coalesce(F.sum("rows"), F.lit(0)).alias("n"))
        if kept is not None:
            before = before.union(kept.groupBy().count())
            index.write(keys.unionByName(kept), batch_id)
        elif not fresh.isEmpty():
            index.write(keys, batch_id)
        rows = append_counted(fresh.drop("day", "bucket", IDENTITY), table_path)
        changed = rows > 0 or kept is not None
        return Added(rows, sum(r.n for r in before.collect()), [of for _, of in touched] if changed else [])
    finally:
        once.unpersist()
        asked.unpersist()


def _in_table(index: KeyIndex, batch_id: int) -> DataFrame:
    """The keys that an earlier run of the batch has both indexed and appended."""
    wrote = index.of_batch(batch_id)
    days = [r.of for r in wrote.select(F.when(F.col("day") != NO_DAY, F.date_from_unix_date("day")).alias("of")).distinct().collect()]
    held = _typed(read_days(index.spark, index.table_path, days))
    return written(wrote.join(held.select(row_identity(held).alias(IDENTITY)), IDENTITY, "left_semi").select("day", "bucket", IDENTITY), "indexed-before")
