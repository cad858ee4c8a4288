"""Many small groups in one Python call: a call for each group costs milliseconds, which millions of them don't bear."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: true in the first row of each group
FIRST = "__first"


def in_groups(rows: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """rows with FIRST; a group is whole within its partition, its rows follow each other in order."""
    place = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn(FIRST, place == 1).sortWithinPartitions(*keys, *order)


def whole_groups(batches: Iterable[pa.RecordBatch], rows: int = 100_000) -> Iterator[pa.Table]:
    """The batches of in_groups cut anew between groups, for mapInArrow.

    A table ends as soon as it has `rows` rows, so it holds no more than these, a batch and a group.
    """
    held, n = [], 0
    for batch in batches:
        starts = np.flatnonzero(flags(batch.column(FIRST)))
        if n + batch.num_rows >= rows and len(starts) and n + starts[-1] > 0:
            last = int(starts[-1])
            yield pa.Table.from_batches([*held, batch.slice(0, last)])
            held, n, batch = [], 0, batch.slice(last)
        held.append(batch)
        n += batch.num_rows
    if n:
        yield pa.Table.from_batches(held)


def flags(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A boolean column without nulls."""
    return column.to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else column.to_numpy()


def firsts(of: np.ndarray) -> np.ndarray:
    """Where each run of equal values begins."""
    return np.flatnonzero(np.r_[True, of[1:] != of[:-1]]) if len(of) else np.zeros(0, np.int64)


def ranges(start: np.ndarray, size: np.ndarray) -> np.ndarray:
    """start, start + 1, ... of each range, end to end."""
    before = np.cumsum(size) - size
    return np.arange(int(size.sum())) + np.repeat(start - before, size)
