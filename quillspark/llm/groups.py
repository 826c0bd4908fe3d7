"""Runs of equal keys in the sorted Arrow batches of a task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The rows of each run of equal long keys as one table; a run may span batches."""
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        new[0] = tuple(c[0] for c in columns) != last
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        last = tuple(c[-1] for c in columns)
        begins = np.flatnonzero(new).tolist()
        if not begins or begins[0] > 0:  # the batch goes on with the run before
            held.append(batch.slice(0, begins[0] if begins else batch.num_rows))
        for a, b in zip(begins, [*begins[1:], batch.num_rows][: len(begins)], strict=True):
            if held:
                yield pa.Table.from_batches(held)
            held = [batch.slice(a, b - a)]
    if held:
        yield pa.Table.from_batches(held)


def whole_runs(batches: Iterator[pa.RecordBatch], key: str, rows: int = 4096) -> Iterator[pa.Table]:
    """The rows as tables of about `rows` rows that break no run of the long column `key`."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            held.append(batch.slice(at, rows))
            if sum(b.num_rows for b in held) < rows:
                continue
            table = pa.Table.from_batches(held)
            values = table.column(key).to_numpy()
            cut = int(np.searchsorted(values, values[-1]))  # sorted within the task
            if cut:
                yield table.slice(0, cut)
            held = table.slice(cut).to_batches()
    if held:
        yield pa.Table.from_batches(held)
