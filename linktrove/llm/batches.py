"""Arrow batches by bytes, and column names that no input uses."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa

from linktrove.sources.batches import small_batches as small_batches

#: Bytes of a text column that are worked on at a time (a longer text alone).
SLICE_BYTES, SLICE_ROWS = 1 << 20, 256


def slices(batch: pa.RecordBatch, column: int, most: int = SLICE_BYTES, rows: int = SLICE_ROWS) -> Iterator[pa.RecordBatch]:
    """Parts of a batch whose values in a string or binary column are of bounded size together."""
    values = batch.column(column)
    large = pa.types.is_large_string(values.type) or pa.types.is_large_binary(values.type)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if large else np.int32)[values.offset:values.offset + len(values) + 1]
    at = 0
    while at < len(values):
        end = max(at + 1, min(int(np.searchsorted(offsets, offsets[at] + most, "right")) - 1, at + rows, len(values)))
        yield batch.slice(at, end - at)
        at = end


def joined(values: pa.Array) -> pa.Buffer:
    """The values of a binary column without NULLs, one behind the other, without a copy."""
    large = pa.types.is_large_binary(values.type)
    offsets = np.frombuffer(values.buffers()[1], np.int64 if large else np.int32)[values.offset:values.offset + len(values) + 1]
    return values.buffers()[2].slice(int(offsets[0]), int(offsets[-1] - offsets[0]))


def unused(columns: Iterable[str], *names: str) -> list[str]:
    """The names, with underscores in front until none is a column's (Spark compares them without case)."""
    taken = {c.lower() for c in columns}
    mark = "_"
    while any((mark + n).lower() in taken for n in names):
        mark += "_"
    return [mark + n for n in names]
