"""Sorted rows as a stream of runs: tasks see the rows of one key together, one key after the other."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame


def dealt(df: DataFrame, keys: list[str], order: list[str] | None = None) -> DataFrame:
    """Rows of equal keys in one task, in a run; within it by `order`."""
    return df.repartition(*keys).sortWithinPartitions(*keys, *(order or []))


def runs(batches: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[pa.Table]:
    """The runs of rows with equal, not null keys. A run may go on over several batches; only one is held."""
    held: list[pa.RecordBatch] = []
    last: tuple = ()
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        change = np.zeros(n - 1, dtype=bool)
        for c in columns:
            change |= c[1:] != c[:-1]
        if held and last != tuple(c[0] for c in columns):
            yield pa.Table.from_batches(held)
            held = []
        for begin, end in pairwise([0, *(np.flatnonzero(change) + 1).tolist(), n]):
            held.append(batch.slice(begin, end - begin))
            if end < n:
                yield pa.Table.from_batches(held)
                held = []
        last = tuple(c[-1] for c in columns)
    if held:
        yield pa.Table.from_batches(held)


def matrix(column: pa.ChunkedArray, dtype: type) -> np.ndarray:
    """A column of lists of one length as a matrix."""
    parts = [np.asarray(c.flatten().to_numpy(zero_copy_only=False), dtype=dtype) for c in column.chunks]
    return np.concatenate(parts).reshape(len(column), -1)
