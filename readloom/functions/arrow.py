"""Small helpers for Arrow-batched functions on sorted partitions."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str], min_rows: int) -> Iterator[pa.Table]:
    """Regroup the batches of a partition sorted by ``keys`` so that no key is
    split, each part having about ``min_rows`` rows or a single larger group.

    The cost does not depend on the number of groups, and at most one part
    plus one group is held.
    """
    held: list[pa.Table] = []
    rows, goal = 0, min_rows
    for batch in batches:
        if batch.num_rows == 0:
            continue
        held.append(pa.Table.from_batches([batch]))
        rows += batch.num_rows
        if rows < goal:
            continue
        table = pa.concat_tables(held).combine_chunks()
        same = np.ones(table.num_rows, dtype=bool)
        for key in keys:
            values = table.column(key).to_numpy()
            same &= values == values[-1]
        other = np.flatnonzero(~same)
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            yield table.slice(0, cut)
            table = table.slice(cut)
            goal = min_rows
        else:
            goal = 2 * rows
        held, rows = [table], table.num_rows
    if rows:
        yield pa.concat_tables(held).combine_chunks()


def columns(table: pa.Table, *names: str) -> list[np.ndarray]:
    return [table.column(n).to_numpy() for n in names]


def run_starts(*keys: np.ndarray) -> np.ndarray:
    """First index of each run of equal keys."""
    n = len(keys[0])
    if n == 0:
        return np.zeros(0, dtype=np.int64)
    new = np.zeros(n, dtype=bool)
    new[0] = True
    for key in keys:
        new[1:] |= key[1:] != key[:-1]
    return np.flatnonzero(new)


def to_batch(fields: dict[str, np.ndarray], schema: pa.Schema) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(fields[f.name], type=f.type) for f in schema], schema=schema
    )
