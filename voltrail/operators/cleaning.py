"""Raw drop -> readings: drop, rename, key, reorder. One `Project` once planned."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from voltrail.functions.keys import decode_key
from voltrail.functions.signals import epoch_key, primary_key
from voltrail.schema import INTERNAL_COLUMNS, READINGS_COLUMNS, READINGS_SCHEMA, SIGNAL_NAMES


def drop_internal(df: DataFrame) -> DataFrame:
    return df.drop(*INTERNAL_COLUMNS)


def rename_signals(df: DataFrame) -> DataFrame:
    """Rename by exact name, so that a column already in table form is left alone."""
    return df.toDF(*[SIGNAL_NAMES.get(c, c) for c in df.columns])


def add_primary_key(df: DataFrame) -> DataFrame:
    return df.withColumn("__primary_key", primary_key())


def add_epoch_key(df: DataFrame) -> DataFrame:
    return df.withColumn("__primary_key", epoch_key())


def conform(df: DataFrame, expected: Sequence[str] = READINGS_COLUMNS) -> DataFrame:
    """The expected columns that are present, in the expected order."""
    return df.select(*[F.col(f"`{c}`") for c in expected if c in df.columns])


def schema_drift(df: DataFrame, expected: T.StructType = READINGS_SCHEMA, profile: bool = False) -> DataFrame:
    """One row per expected or actual column: `ok`, `missing`, `unexpected` or `type_differs`.

    `profile` adds the number of non-NULL values per column, at the price of
    one aggregate over the input.
    """
    want = {f.name: f.dataType.simpleString() for f in expected}
    have = {f.name: f.dataType.simpleString() for f in df.schema}

    def status(name: str) -> str:
        if name not in have:
            return "missing"
        if name not in want:
            return "unexpected"
        return "ok" if want[name] == have[name] else "type_differs"

    rows = [(n, want.get(n), have.get(n), status(n)) for n in [*want, *[n for n in have if n not in want]]]
    report = df.sparkSession.createDataFrame(
        rows, "column_name string, expected_type string, actual_type string, status string"
    )
    if not profile:
        return report
    return report.join(non_null_counts(df), "column_name", "left").withColumn(
        "non_null", F.coalesce("non_null", F.lit(0).cast("long"))
    )


def non_null_counts(df: DataFrame) -> DataFrame:
    """(column_name, non_null) for every column, from a single aggregate."""
    counts = df.agg(*[F.count(F.col(f"`{c}`")).alias(c) for c in df.columns])
    pairs = F.array(*[
        F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").alias("non_null")) for c in df.columns
    ])
    return counts.select(F.inline(pairs))


def clean_readings(raw: DataFrame) -> DataFrame:
    return conform(add_primary_key(rename_signals(drop_internal(raw))))


def url_decode_key(df: DataFrame, col: str, out: str = "decoded_key") -> DataFrame:
    return df.withColumn(out, decode_key(F.col(col)))
