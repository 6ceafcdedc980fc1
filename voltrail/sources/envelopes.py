"""Storage notifications: JSON message bodies that name landed objects."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.functions.keys import decode_key, is_landing_key
from voltrail.schema import ENVELOPE_SCHEMA


def unpack_event_envelope(df: DataFrame, body: str = "body", out: str = "key", strict: bool = True) -> DataFrame:
    """One row per object key in place of the body.

    Messages without a body, bodies without `Records` and records without a key
    give no row. A body that is not JSON fails the job, so that the message is
    delivered again; `strict=False` skips it.
    """
    mode = "FAILFAST" if strict else "PERMISSIVE"
    parsed = F.from_json(F.col(body), ENVELOPE_SCHEMA, {"mode": mode})
    rest = [c for c in df.columns if c != body]
    return (
        df.where(F.col(body).isNotNull())
        .select(*rest, F.explode(parsed["Records"]).alias("record"))
        .select(*rest, F.col("record.s3.object.key").alias(out))
        .where(F.col(out).isNotNull())
    )


def filter_landing_keys(df: DataFrame, key: str = "key") -> DataFrame:
    """Decode `key` and keep archives under `raw/`."""
    return df.withColumn(key, decode_key(F.col(key))).where(is_landing_key(F.col(key)))
