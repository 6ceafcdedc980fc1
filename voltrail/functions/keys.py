"""Column expressions over object keys and member paths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

RAW_PREFIX = "raw/"
ARCHIVE_SUFFIXES = (".zip", ".7z")


def decode_key(key: Column) -> Column:
    """Percent and plus decoding; a percent sign without two hex digits stays as it is."""
    return F.url_decode(F.regexp_replace(key, "%(?![0-9A-Fa-f]{2})", "%25"))


def basename(path: Column) -> Column:
    return F.substring_index(path, "/", -1)


def is_archive_name(key: Column) -> Column:
    suffix = F.lit(False)
    for ending in ARCHIVE_SUFFIXES:
        suffix = suffix | key.endswith(ending)
    return suffix


def is_landing_key(key: Column) -> Column:
    """A decoded key under `raw/` that names an archive."""
    return key.contains(RAW_PREFIX) & is_archive_name(key)


def _segments(path: str) -> list[str]:
    return [s for s in path.split("/") if s]


def resolved_segments(name: Column, root: str) -> Column:
    """`root/name` as a list of path segments with `.` and `..` resolved."""
    start = F.array(*[F.lit(s) for s in _segments(root)]).cast("array<string>")

    def step(seen: Column, segment: Column) -> Column:
        return (
            F.when(segment.isin("", "."), seen)
            .when(segment == "..", F.slice(seen, 1, F.greatest(F.size(seen) - 1, F.lit(0))))
            .otherwise(F.concat(seen, F.array(segment)))
        )

    return F.aggregate(F.split(name, "/"), start, step)


def safe_member_path(name: Column, root: str) -> Column:
    """Path of a member relative to `root`, or NULL when it would leave `root`."""
    top = _segments(root)
    resolved = resolved_segments(name, root)
    inside = F.slice(resolved, 1, len(top)) == F.array(*[F.lit(s) for s in top]) if top else F.lit(True)
    return F.when(inside, F.array_join(F.slice(resolved, len(top) + 1, F.size(resolved)), "/"))
