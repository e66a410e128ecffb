"""Streams of sorted rows cut into whole groups, for work inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

from attesta.llm.common import release


def whole_groups(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Tables that hold whole groups only, with the bounds of the groups; rows of a group follow each other in the input.

    Holds a batch and one unfinished group in memory, so groups must be bounded by the caller.
    """
    held: list[pa.RecordBatch] = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        starts = _starts(batch, keys)
        first = _key(batch, keys, 0)
        if held and first != last:
            yield _cut(held, keys)
            held = []
        if len(starts) > 1:
            held.append(batch.slice(0, int(starts[-1])))
            yield _cut(held, keys)
            held = [batch.slice(int(starts[-1]))]
        else:
            held.append(batch)
        last = _key(batch, keys, batch.num_rows - 1)
    if held:
        yield _cut(held, keys)
    release()


def _key(batch, keys, i):
    return tuple(batch.column(k)[i].as_py() for k in keys)


def _starts(batch, keys) -> np.ndarray:
    new = np.zeros(batch.num_rows, bool)
    new[0] = True
    for k in keys:
        x = batch.column(k).to_numpy(zero_copy_only=False)
        new[1:] |= x[1:] != x[:-1]
    return np.flatnonzero(new)


def _cut(held, keys) -> tuple[pa.Table, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    batch = table.to_batches()[0]
    return table, np.append(_starts(batch, keys), table.num_rows)


def forest(linked: np.ndarray) -> np.ndarray:
    """For each row of a symmetric boolean matrix, the first row of its connected component."""
    n = len(linked)
    label = np.arange(n)
    while True:
        new = np.where(linked, label[None, :], n).min(1, initial=n)
        new = np.minimum(new, label)
        new = new[new]
        if (new == label).all():
            return label
        label = new
