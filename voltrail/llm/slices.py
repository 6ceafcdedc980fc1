"""Arrow batches of texts, worked off a slice at a time: only a slice's texts are Python objects at once."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa

SLICE_ROWS = 500


def by_slices(work: Callable[..., list], kind: pa.DataType, *columns: pa.Array) -> pa.Array:
    """What `work` makes of the rows of each slice of `columns`, as one array of `kind`: a list item or tuple a row."""
    names = [field.name for field in kind] if pa.types.is_struct(kind) else None
    parts = []
    for at in range(0, max(1, len(columns[0])), SLICE_ROWS):
        rows = work(*(column.slice(at, SLICE_ROWS).to_pylist() for column in columns))
        parts.append(pa.array([dict(zip(names, row)) for row in rows] if names else rows, kind))
    return pa.concat_arrays(parts)
