"""Session settings and the shared folder for intermediate tables."""

from __future__ import annotations

import sys
import time
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from contextvars import ContextVar

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession

SESSION_CONF = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.coalescePartitions.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.streaming.stateStore.providerClass":
        "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.ui.enabled": "false",
}


def build_session(app_name: str = "voltrail", master: str | None = None, **conf: str) -> SparkSession:
    """A session with the settings this package expects; `conf` entries win."""
    builder = SparkSession.builder.appName(app_name)
    if master:
        builder = builder.master(master)
    for key, value in {**SESSION_CONF, **conf}.items():
        builder = builder.config(key, value)
    return builder.getOrCreate()


def shared_dir(spark: SparkSession) -> str:
    """The folder every executor can reach: `spark.checkpoint.dir`, or else a folder in the warehouse."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return qualified(spark, named.rstrip("/"))
    return qualified(spark, spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_work")


def qualified(spark: SparkSession, path: str) -> str:
    """The path with its scheme, so that Spark and Python tasks mean the same file system."""
    if ":" in path.split("/", 1)[0]:
        return path
    return spark.sparkContext._jsc.hadoopConfiguration().get("fs.defaultFS").rstrip("/") + path


def work_path(spark: SparkSession, label: str) -> str:
    """A path under the shared folder that no other call uses."""
    return f"{shared_dir(spark)}/voltrail/{label}-{uuid.uuid4().hex}"


def send_to_tasks(module: str) -> None:
    """Send the module's functions to Python tasks by value: executors need no copy of this package."""
    cloudpickle.register_pickle_by_value(sys.modules[module])


def fan_out(spark: SparkSession) -> int:
    """Task count for work whose cost is not visible in its shuffle bytes."""
    return max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)


def _store(spark: SparkSession, path: str):
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    return folder, folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def path_exists(spark: SparkSession, path: str) -> bool:
    folder, store = _store(spark, path)
    return store.exists(folder)


def make_folder(spark: SparkSession, path: str) -> None:
    folder, store = _store(spark, path)
    store.mkdirs(folder)


def move_file(spark: SparkSession, path: str, below: str) -> bool:
    """Move the file to the folder `below`, which keeps its whole path."""
    source, store = _store(spark, path)
    target = spark._jvm.org.apache.hadoop.fs.Path(below.rstrip("/") + source.toUri().getPath())
    store.mkdirs(target.getParent())
    return store.rename(source, target)


def subfolders(spark: SparkSession, parent: str) -> list[str]:
    """The names of the folders directly in `parent`; none if it does not exist."""
    folder, store = _store(spark, parent)
    return sorted(e.getPath().getName() for e in store.listStatus(folder) if e.isDirectory()) if store.exists(folder) else []


def remove_folders(spark: SparkSession, parent: str, is_stale: Callable[[str], bool], older_than_seconds: float) -> int:
    """Remove the folders in `parent` whose name is stale and that were last changed so long ago; returns their number."""
    folder, store = _store(spark, parent)
    if not store.exists(folder):
        return 0
    latest, removed = (time.time() - older_than_seconds) * 1000, 0
    for entry in store.listStatus(folder):
        if is_stale(entry.getPath().getName()) and entry.getModificationTime() <= latest:
            removed += bool(store.delete(entry.getPath(), True))
    return removed


@contextmanager
def _setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    before = spark.conf.get(name)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, before)


def shuffles_freed(spark: SparkSession):
    """Writes inside remove their shuffle files as they end, as nothing reads those again."""
    return _setting(spark, "spark.sql.classic.shuffleDependency.fileCleanup.enabled", "true")


#: So many rows of whole texts go through a Python task's memory at a time.
TEXT_ROWS = 1000


def arrow_rows(spark: SparkSession, rows: int):
    """Jobs inside send Python tasks so many rows at a time: few where rows hold whole texts."""
    return _setting(spark, "spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


_FOLDERS: ContextVar[list[str] | None] = ContextVar("folders", default=None)


#: For few large rows: a writer holds a row group and a page in memory, a reader up to a row group. Their sizes are looked
#: at every ten rows: a guess from the rows so far is far off where small rows come first.
LARGE_ROWS = {
    "parquet.block.size": str(16 << 20),
    **{f"parquet.{part}.size.row.check.{bound}": "10" for part in ("block", "page") for bound in ("min", "max")},
}


def written(df: DataFrame, label: str, **options: str) -> DataFrame:
    """The rows written once to the shared folder and read back: later stages neither repeat nor lose them."""
    path = work_path(df.sparkSession, label)
    folders = _FOLDERS.get()
    if folders is not None:
        folders.append(path)
    with shuffles_freed(df.sparkSession):
        df.write.options(**options).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def large_rows_written(df: DataFrame, label: str) -> DataFrame:
    """`written`, for few large rows."""
    return written(df, label, **LARGE_ROWS)


@contextmanager
def work_folders_removed(spark: SparkSession) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """What `written` makes inside is removed at the end, but for the last table, where that is passed to the given function.

    Inside, nothing may return rows that still have to be read from a removed folder.
    """
    outer, own = _FOLDERS.get(), []
    kept: list[str] = []

    def keep(last: DataFrame) -> DataFrame:
        kept.append(own.pop())
        return last

    token = _FOLDERS.set(own)
    try:
        yield keep
    finally:
        _FOLDERS.reset(token)
        if outer is not None:
            outer.extend(kept)
        for path in own:
            folder, store = _store(spark, path)
            store.delete(folder, True)
