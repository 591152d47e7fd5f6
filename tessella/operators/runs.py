"""Rows that come sorted by keys, many groups a batch: no group is cut, no batch holds one group alone."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def changes(batch: pa.RecordBatch | pa.Table, keys: list[str]) -> np.ndarray:
    """Places of the rows whose keys differ from the row before."""
    out = np.zeros(max(0, batch.num_rows - 1), bool)
    for key in keys:
        column = batch.column(batch.schema.get_field_index(key)).to_numpy(zero_copy_only=False) if isinstance(batch, pa.RecordBatch) else batch[key].to_numpy()
        out |= column[1:] != column[:-1]
    return np.flatnonzero(out) + 1


def whole_runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """Tables of whole groups; what is held back is the last group, which may go on."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        if not batch.num_rows:
            continue
        if held and any(held[-1].column(k)[-1] != batch.column(k)[0] for k in keys):
            yield pa.Table.from_batches(held)
            held = []
        starts = changes(batch, keys)
        if len(starts):
            last = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held = []
            batch = batch.slice(last)
        held.append(batch)
    if held:
        yield pa.Table.from_batches(held)
