"""What the operators share: the given tables, base32, word patterns and the step to one row per document."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

SPACE = r"\x20\x09-\x0D"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

DOCUMENTS = "doc_id bigint, text string, lang string, source string, n_chars bigint"
TABLES = {
    "documents": DOCUMENTS,
    "embeddings": "vec_id bigint, embedding array<float>, label int",
    "pages": "page_id bigint, url string, html string",
    "benchmark": "item_id bigint, text string",
    "labels": "doc_id bigint, quality int, toxic int",
    "conversations": "conv_id bigint, turn bigint, role string, text string",
}


def given(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A given table under its known schema."""
    return spark.read.schema(TABLES[name]).parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(text: Column) -> Column:
    """A-Z lower-cased, every other letter as it is."""
    return F.translate(text, UPPER, LOWER)


def base32(hex_digest: Column, digits: int = 40) -> Column:
    """Hexadecimal digits as upper-case base32; `digits` is a multiple of ten, so no padding arises."""
    parts = [
        F.lpad(F.conv(F.substring(hex_digest, at + 1, 10), 16, 32), 8, "0") for at in range(0, digits, 10)
    ]
    return F.translate(F.concat(*parts), "0123456789ABCDEFGHIJKLMNOPQRSTUV", UPPER + "234567")


def crc32_sql(column: str) -> str:
    """DuckDB SQL for the unsigned CRC-32 of a column's decimal digits, bit by bit; null for null."""
    turns = ", ".join(["-1"] * 8)
    steps = f"flatten(list_transform(string_split(CAST({column} AS VARCHAR), ''), lambda ch: [CAST(ord(ch) AS BIGINT), {turns}]))"
    step = "CASE WHEN x >= 0 THEN xor(c, x) WHEN (c & 1) = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
    reduced = f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), {steps}), lambda c, x: {step}), 4294967295)"
    return f"CASE WHEN {column} IS NOT NULL THEN {reduced} END"
