"""Texts of Arrow batches as arrays of bytes: what the operators on whole batches share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def text_parts(batches: Iterator[pa.RecordBatch], column: int = 1, limit: int = 4 << 20) -> Iterator[tuple[pa.RecordBatch, np.ndarray, np.ndarray]]:
    """(rows, bytes, offsets): stretches of a batch whose texts hold at most ``limit`` bytes (or one text), null as the empty text.

    ``bytes[offsets[i]:offsets[i + 1]]`` is the text of row i in UTF-8.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        text = pc.fill_null(batch.column(column), "").cast(pa.binary()).cast(pa.large_binary())
        at = np.frombuffer(text.buffers()[1], np.int64)[text.offset:text.offset + len(text) + 1]
        held = text.buffers()[2]
        data = np.frombuffer(held, np.uint8) if held is not None else np.zeros(0, np.uint8)
        lo = 0
        while lo < batch.num_rows:
            hi = max(lo + 1, int(np.searchsorted(at, at[lo] + limit, "right")) - 1)
            yield batch.slice(lo, hi - lo), data[at[lo]:at[hi]], at[lo:hi + 1] - at[lo]
            lo = hi


def rows_of(columns: dict[str, object], schema: str) -> pa.RecordBatch:
    """A batch of the named columns, in the order and types of a simple DDL schema."""
    kinds = {"long": pa.int64(), "int": pa.int32(), "string": pa.string(), "binary": pa.binary(), "array<int>": pa.list_(pa.int32())}
    fields = [c.split(" ") for c in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(columns[name], kinds[kind]) for name, kind in fields], names=[name for name, _ in fields])
