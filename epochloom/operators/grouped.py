"""Whole groups out of sorted Arrow batches.

``groupBy(...).applyInPandas`` pays about a millisecond a group; with many small groups that is most of the time. Rows that are
hashed by their keys and sorted within partitions reach :func:`whole_groups` instead, which hands over many groups at a
time, so that the work on them can be vectorised.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc


def group_starts(rows: pa.Table, keys: int) -> np.ndarray:
    """Where each group of equal first ``keys`` columns begins; null equals null."""
    new = np.zeros(max(rows.num_rows - 1, 0), bool)
    for k in range(keys):
        a, b = rows.column(k).slice(0, len(new)), rows.column(k).slice(1)
        differ = pc.or_(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
        new |= differ.to_numpy()
    return np.r_[0, np.flatnonzero(new) + 1] if rows.num_rows else np.zeros(0, np.int64)


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int, rows: int = 200_000) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """(table, starts of its groups), of about ``rows`` rows; a group is never divided. The rows of a group must follow each other."""
    held, size, least = [], 0, rows
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        size += batch.num_rows
        if size < least:
            continue
        table = pa.Table.from_batches(held)
        starts = group_starts(table, keys)
        if len(starts) == 1:  # one group so far: look again when there is twice as much
            least = 2 * size
            continue
        yield table.slice(0, starts[-1]).combine_chunks(), starts[:-1]
        held, size, least = table.slice(starts[-1]).to_batches(), table.num_rows - int(starts[-1]), rows
    if held:
        table = pa.Table.from_batches(held).combine_chunks()
        yield table, group_starts(table, keys)
