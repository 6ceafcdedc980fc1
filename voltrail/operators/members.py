"""Archive member lists and content as tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voltrail.functions.content import container_type, decrypt, digests, encrypt
from voltrail.functions.keys import safe_member_path
from voltrail.operators.ranks import number_within


def select_members(df: DataFrame, targets: Sequence[str] | DataFrame, name: str = "filename") -> DataFrame:
    """Members named exactly by `targets`: a list, or a one-column DataFrame of any size."""
    if isinstance(targets, DataFrame):
        wanted = targets.select(F.col(targets.columns[0]).alias(name))
        return df.join(wanted, name, "left_semi")
    return df.where(F.col(name).isin(list(targets)))


def select_members_recursive(df: DataFrame, targets: Sequence[str], name: str = "filename") -> DataFrame:
    """Members whose name starts with any of `targets`."""
    chosen = F.lit(False)
    for target in targets:
        chosen = chosen | F.col(name).startswith(target)
    return df.where(chosen)


def rename_duplicate_members(
    df: DataFrame, archive: str = "archive", name: str = "filename", position: str = "member_no"
) -> DataFrame:
    """`output_name`: the first use of a name in an archive keeps it, later ones get `_0`, `_1` ..."""
    numbered = number_within(df, [archive, name], position, "__use")
    suffix = F.when(F.col("__use") > 1, F.concat(F.lit("_"), (F.col("__use") - 2).cast("string")))
    return numbered.withColumn(
        "output_name", F.concat(F.col(name), F.coalesce(suffix, F.lit("")))
    ).drop("__use")


def reject_unsafe_paths(df: DataFrame, name: str = "filename", root: str = "landing/processed") -> DataFrame:
    """`safe_path` relative to the root, NULL when the member would be written outside it."""
    return df.withColumn("safe_path", safe_member_path(F.col(name), root)).withColumn(
        "is_safe", F.col("safe_path").isNotNull()
    )


def detect_container_type(df: DataFrame, content: str = "content") -> DataFrame:
    return df.withColumn("container_type", container_type(F.col(content)))


def content_digests(df: DataFrame, content: str = "content") -> DataFrame:
    """The digests in place of the content."""
    return df.withColumns(digests(F.col(content))).drop(content)


def duplicate_content(df: DataFrame, id_col: str, content: str = "content") -> DataFrame:
    """Groups of rows with equal content: digest, smallest id, number of copies."""
    return (
        df.groupBy(F.sha2(F.col(content), 256).alias("sha256"))
        .agg(F.min(id_col).alias(f"first_{id_col}"), F.count(F.lit(1)).alias("copies"))
        .where("copies > 1")
    )


def protect_columns(df: DataFrame, columns: Sequence[str], key: bytes, mode: str = "GCM") -> DataFrame:
    """Replace each column by its ciphertext. GCM draws a new nonce per value, so equal values differ."""
    return df.withColumns({c: encrypt(F.col(c).cast("string"), F.lit(key), mode) for c in columns})


def reveal_columns(df: DataFrame, columns: Sequence[str], key: bytes, mode: str = "GCM") -> DataFrame:
    return df.withColumns({c: decrypt(F.col(c), F.lit(key), mode) for c in columns})
