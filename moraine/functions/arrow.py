"""Bounded-memory iteration over sorted Arrow partitions."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa


def complete_groups(batches: Iterable[pa.RecordBatch], key: str, target: int = 8192, limit: int = 65536) -> Iterator[tuple[pa.Table, bool]]:
    """Tables of whole runs of equal `key` from a partition sorted by key, and whether the last run goes on.

    About `target` rows at a time; a run longer than `limit` rows is given in pieces (True: its rest
    follows), so memory stays bounded whatever the group sizes.
    """
    held: list[pa.RecordBatch] = []
    rows = 0
    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        rows += batch.num_rows
        if rows < target:
            continue
        table = pa.Table.from_batches(held).combine_chunks()
        keys = table[key].to_numpy()
        change = np.flatnonzero(keys[1:] != keys[:-1]) + 1
        if len(change):
            at = int(change[-1])
            yield table.slice(0, at), False
            rest = table.slice(at)
        elif rows > limit:
            yield table, True
            rest = table.slice(rows)
        else:
            rest = table
        held, rows = rest.to_batches() if rest.num_rows else [], rest.num_rows
    if held:
        yield pa.Table.from_batches(held).combine_chunks(), False


def whole_groups(batches: Iterable[pa.RecordBatch], key: str, target: int, limit: int) -> Iterator[pa.Table]:
    """complete_groups for keys whose runs are bounded by construction: one longer than `limit` is an error, never cut."""
    for table, goes_on in complete_groups(batches, key, target, limit):
        if goes_on:
            raise ValueError(f"more than {limit} rows of one {key}")
        yield table


def run_bounds(keys: np.ndarray) -> np.ndarray:
    """Start offsets of the runs of equal keys, and the end."""
    if not len(keys):
        return np.zeros(1, np.int64)
    return np.concatenate([[0], np.flatnonzero(keys[1:] != keys[:-1]) + 1, [len(keys)]])
