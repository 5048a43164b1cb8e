"""Whole groups of rows from sorted partitions, without a Python call for each group."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def whole_groups(batches: Iterator[pa.RecordBatch], key: str) -> Iterator[pa.Table]:
    """Tables that hold only whole groups; the input is sorted by key, which is never null."""
    held: list[pa.Table] = []
    held_key = None
    for b in batches:
        t = pa.Table.from_batches([b])
        if not t.num_rows:
            continue
        k = t[key].to_numpy()
        cut = int(np.argmax(k == k[-1]))
        if cut:
            yield pa.concat_tables([*held, t.slice(0, cut)])
            held = [t.slice(cut)]
        elif held and held_key != k[-1]:
            yield pa.concat_tables(held)
            held = [t]
        else:
            held.append(t)
        held_key = k[-1]
    if held:
        yield pa.concat_tables(held)


def one_chunk(column: pa.ChunkedArray) -> pa.Array:
    return column.chunk(0) if column.num_chunks == 1 else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def bounds(key: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal keys."""
    return np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)]]) if len(key) else np.zeros(1, np.int64)


def pairs_within(off: np.ndarray, most: int = 1 << 20) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """All pairs i < j of the same run, in pieces."""
    n = int(off[-1])
    run_end = np.repeat(off[1:], np.diff(off))
    mates = run_end - np.arange(n) - 1
    total = np.concatenate([[0], np.cumsum(mates)])
    lo = 0
    while lo < n:
        hi = int(np.searchsorted(total, total[lo] + most, "right")) - 1
        hi = min(max(hi, lo + 1), n)
        m = mates[lo:hi]
        a = np.repeat(np.arange(lo, hi), m)
        if len(a):
            b = np.arange(len(a)) - np.repeat(total[lo:hi] - total[lo], m) + a + 1
            yield a, b
        lo = hi


def forest(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """For each of n nodes the least node of its component under the links a-b."""
    root = np.arange(n)
    while True:
        low = np.minimum(root[a], root[b])
        new = root.copy()
        np.minimum.at(new, root[a], low)
        np.minimum.at(new, root[b], low)
        while True:
            jump = new[new]
            if np.array_equal(jump, new):
                break
            new = jump
        if np.array_equal(new, root):
            return root
        root = new
