"""A landing zone of ZIP archives made from `documents`, 64 documents to an archive."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from registry.inputs import table
from voltrail.session import send_to_tasks, work_path
from voltrail.sources.archives import landed_archives, scan_archives
from voltrail.sources.containers import filesystem

send_to_tasks(__name__)

PER_ARCHIVE = 64


def documents_in_archives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select(
        F.floor(F.col("doc_id") / PER_ARCHIVE).alias("archive_no"), "doc_id", "lang", "text"
    )


def zip_bytes(members: Iterator[tuple[str, str]], method: int) -> bytes:
    buffer = io.BytesIO()
    with zipfile.ZipFile(buffer, "w", method) as archive:
        for name, text in members:
            info = zipfile.ZipInfo(name, date_time=(2024, 1, 2, 3, 4, 6))
            info.compress_type = method
            archive.writestr(info, text.encode())
    return buffer.getvalue()


def land_documents(spark: SparkSession, sf_dir: str, deflate: bool = False, damage: str | None = None) -> str:
    """Write the archives below a new `raw/` folder; returns the folder.

    `damage` changes the first byte of every document of that language after its
    checksum was taken, which stored (not deflated) members allow.
    """
    root = work_path(spark, "landing") + "/raw"
    method = zipfile.ZIP_DEFLATED if deflate else zipfile.ZIP_STORED

    def write(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values("doc_id")
        names = [f"{lang}/doc-{no}.txt" for no, lang in zip(group["doc_id"], group["lang"])]
        content = bytearray(zip_bytes(zip(names, group["text"]), method))
        for name in names:
            if damage and name.startswith(f"{damage}/"):
                start = content.index(name.encode()) + len(name)
                content[start] ^= 1
        store, folder = filesystem(root)
        store.create_dir(folder, recursive=True)
        path = f"{folder}/docs-{group['archive_no'].iloc[0]}.zip"
        with store.open_output_stream(path) as sink:
            sink.write(bytes(content))
        return pd.DataFrame({"path": [path]})

    documents_in_archives(spark, sf_dir).groupBy("archive_no").applyInPandas(write, "path string").count()
    return root


def landed(spark: SparkSession, sf_dir: str, **options) -> DataFrame:
    return landed_archives(scan_archives(spark, land_documents(spark, sf_dir, **options)))
