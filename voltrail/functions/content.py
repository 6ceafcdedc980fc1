"""Column expressions over binary content."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Leading bytes of known containers, in hex.
MAGIC_NUMBERS = {
    "7z": "377ABCAF271C",
    "zip": "504B0304",
    "zip_empty": "504B0506",
    "gzip": "1F8B",
    "bzip2": "425A68",
    "xz": "FD377A585A00",
    "zstd": "28B52FFD",
    "parquet": "50415231",
}


def container_type(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 6))
    kind = F.lit("unknown")
    for name, magic in reversed(MAGIC_NUMBERS.items()):
        kind = F.when(head.startswith(magic), name).otherwise(kind)
    return F.when(content.isNotNull(), kind)


def digests(content: Column) -> dict[str, Column]:
    return {
        "md5": F.md5(content),
        "sha1": F.sha1(content),
        "sha256": F.sha2(content, 256),
        "crc32": F.crc32(content),
    }


def encrypt(value: Column, key: Column, mode: str = "GCM") -> Column:
    """Base64 of the AES ciphertext; NULL stays NULL."""
    return F.base64(F.aes_encrypt(value, key, F.lit(mode)))


def decrypt(value: Column, key: Column, mode: str = "GCM") -> Column:
    return F.aes_decrypt(F.unbase64(value), key, F.lit(mode)).cast("string")
