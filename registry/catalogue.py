"""Every registered query by name."""

from __future__ import annotations

from registry import (
    archive_queries,
    cleaning_queries,
    dashboard_queries,
    feature_queries,
    rollup_queries,
    stream_queries,
    table_queries,
)
from registry.inputs import Query

MODULES = (rollup_queries, feature_queries, cleaning_queries, table_queries, archive_queries, stream_queries,
           dashboard_queries)


def all_queries() -> dict[str, Query]:
    merged: dict[str, Query] = {}
    for module in MODULES:
        for name, query in module.QUERIES.items():
            if name in merged:
                raise ValueError(f"query registered twice: {name}")
            merged[name] = query
    return merged
