"""Reading raw drops, and the literal sample rows."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence
from datetime import datetime

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrail.operators.cleaning import add_epoch_key, conform
from voltrail.schema import READINGS_SCHEMA, SAMPLE_INSTANT, SAMPLE_SIGNALS


def scan_readings(
    spark: SparkSession, path: str, schema: T.StructType | None = None, merge_schema: bool = False,
    drops: Sequence[str] | None = None,
) -> DataFrame:
    """All Parquet drops under `path`, or only the files named in `drops`; folders below `path` may name columns.

    Without a schema Spark reads it from one footer. Passing one avoids even that
    and reads columns a drop lacks as NULL; `merge_schema` looks at every footer.
    """
    reader = spark.read.option("mergeSchema", str(merge_schema).lower())
    if schema is not None:
        reader = reader.schema(schema)
    if drops is None:
        return reader.parquet(path)
    return reader.option("basePath", path).parquet(*[re.sub(r"([\[\]{}*?\\])", r"\\\1", drop) for drop in drops])


def sample_readings(spark: SparkSession, instant: datetime = SAMPLE_INSTANT) -> DataFrame:
    """The two test rows with the table's own types; their key is `vin_epochseconds`."""
    signals = T.StructType(READINGS_SCHEMA.fields[1:])
    rows = spark.createDataFrame([(*row, instant) for row in SAMPLE_SIGNALS], signals)
    return conform(add_epoch_key(rows))


def read_or_sample(
    spark: SparkSession, path: str, prepare: Callable[[DataFrame], DataFrame] = lambda drops: drops,
    schema: T.StructType | None = None,
) -> DataFrame:
    """The drops under `path` after `prepare`, or the sample rows when there is no such path.

    Pass a schema where drops may differ: without one, the columns of one footer
    stand for all. Any other failure is the caller's to see.
    """
    try:
        drops = scan_readings(spark, path, schema)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return sample_readings(spark)
    return prepare(drops)


def no_rows(spark: SparkSession, schema: T.StructType | str) -> DataFrame:
    """No rows, which the optimizer knows: a union with them runs no Python task to find that out."""
    return spark.createDataFrame([], schema).where(F.lit(False))


def read_if_there(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """The Parquet folder, or no rows before the first write."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return no_rows(spark, schema)
