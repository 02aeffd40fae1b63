"""Sorted rows of many groups in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def whole_groups(batches: Iterator[pa.RecordBatch], by: list[str], least: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables of whole groups of the sorted rows, at least `least` rows each but for the last, and where a group begins."""
    waiting: list[pa.RecordBatch] = []
    size = 0
    for batch in batches:
        waiting.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(waiting)
        fresh = begins(table, by)
        cut = int(np.flatnonzero(fresh)[-1])
        if cut:
            yield table.slice(0, cut), fresh[:cut]
        rest = table.slice(cut)
        waiting, size = rest.to_batches(), rest.num_rows
    if size:
        table = pa.Table.from_batches(waiting)
        yield table, begins(table, by)


def begins(table: pa.Table, by: list[str]) -> np.ndarray:
    """True where a row differs from the one before in one of the columns; nulls are alike."""
    fresh = np.zeros(table.num_rows, bool)
    fresh[:1] = True
    for c in by:
        column = table.column(c).combine_chunks()
        here, before = column.slice(1), column.slice(0, len(column) - 1)
        differ = pc.fill_null(pc.not_equal(here, before), False)
        if column.null_count:
            differ = pc.or_(differ, pc.xor(here.is_null(), before.is_null()))
        fresh[1:] |= differ.to_numpy(zero_copy_only=False)
    return fresh
