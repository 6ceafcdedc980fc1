"""Exactly-once micro-batch sinks built on idempotent writes.

Each micro-batch writes one folder named after its batch id and overwrites it if
the batch is run again, so a restart from the checkpoint neither loses nor
doubles rows. `compact_batches` replaces many small results by their merge and
removes them after a grace period, so that reading stays cheap and the folders
few however long the stream runs. Nothing passes through the driver.

    out/batches/batch_id=<n>     result of micro-batch n
    out/compacted/batch_id=<n>   merge of the results up to n
    out/compactions              the finished merges
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from voltrail.session import remove_folders
from voltrail.sources.readings import read_if_there

Transform = Callable[[DataFrame], DataFrame]

GRACE_SECONDS = 6 * 3600

_COMPACTIONS = T.StructType([T.StructField("upto", T.LongType())])


def batch_path(out: str, batch_id: int) -> str:
    return f"{out}/batches/batch_id={batch_id}"


def start_batches(
    stream: DataFrame,
    out: str,
    checkpoint: str,
    transform: Transform = lambda batch: batch,
    mode: str = "append",
    available_now: bool = True,
    every: str = "1 minute",
) -> StreamingQuery:
    """Write `transform(batch)` of every micro-batch to a folder of its own below `out`."""

    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").parquet(batch_path(out, batch_id))

    return start_each(stream, write, checkpoint, mode, available_now, every)


def start_each(
    stream: DataFrame,
    write: Callable[[DataFrame, int], None],
    checkpoint: str,
    mode: str = "append",
    available_now: bool = True,
    every: str = "1 minute",
) -> StreamingQuery:
    trigger = {"availableNow": True} if available_now else {"processingTime": every}
    return (
        stream.writeStream.outputMode(mode).option("checkpointLocation", checkpoint)
        .trigger(**trigger).foreachBatch(write).start()
    )


def _written(like: DataFrame, path: str) -> DataFrame:
    schema = T.StructType([*like.schema.fields, T.StructField("batch_id", T.LongType())])
    return read_if_there(like.sparkSession, path, schema)


def read_batches(like: DataFrame, out: str) -> DataFrame:
    """The newest merge and every later result; `like` gives the columns, `batch_id` is added.

    The newest merge is a scalar subquery over partition values, so older folders are not read.
    """
    done = read_if_there(like.sparkSession, f"{out}/compactions", _COMPACTIONS)
    newest = F.coalesce(done.agg(F.max("upto")).scalar(), F.lit(-1))
    merged = _written(like, f"{out}/compacted").where(F.col("batch_id") == newest)
    return merged.unionByName(_written(like, f"{out}/batches").where(F.col("batch_id") > newest))


def compact_batches(
    like: DataFrame, out: str, merge: Transform = lambda results: results, grace_seconds: float = GRACE_SECONDS
) -> int | None:
    """Merge all results but the last one, which might still be written; returns the last batch merged.

    Readers use the merge once it is complete and recorded. Results that it
    covers, and older merges, go when they are older than `grace_seconds`, which
    is how long a query over them may take. May run beside the stream.
    """
    spark = like.sparkSession
    last = _written(like, f"{out}/batches").agg(F.max("batch_id")).first()[0]
    done = read_if_there(spark, f"{out}/compactions", _COMPACTIONS).agg(F.max("upto")).first()[0]
    upto = -1 if last is None else last - 1
    if upto < 0 or done is not None and upto <= done:
        _shed(spark, out, done, grace_seconds)
        return done
    results = read_batches(like, out).where(F.col("batch_id") <= upto)
    merge(results).select(*like.columns).write.mode("overwrite").parquet(f"{out}/compacted/batch_id={upto}")
    spark.createDataFrame([(upto,)], _COMPACTIONS).coalesce(1).write.mode("append").parquet(f"{out}/compactions")
    _shed(spark, out, upto, grace_seconds)
    return upto


def _shed(spark: SparkSession, out: str, upto: int | None, grace_seconds: float) -> None:
    """Remove what the merge up to `upto` has replaced."""
    if upto is None:
        return

    def number(folder: str) -> int | None:
        return int(folder.removeprefix("batch_id=")) if folder.startswith("batch_id=") else None

    remove_folders(spark, f"{out}/batches", lambda f: number(f) is not None and number(f) <= upto, grace_seconds)
    remove_folders(spark, f"{out}/compacted", lambda f: number(f) is not None and number(f) < upto, grace_seconds)
