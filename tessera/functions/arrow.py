"""Arrow batches in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def runs(items: Iterator[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    """Stretches of sorted batches with equal keys, which are numbers."""
    for batch in items:
        if batch.num_rows:
            columns = np.stack([batch.column(k).to_numpy(zero_copy_only=False) for k in keys])
            cuts = [0, *(np.flatnonzero((columns[:, 1:] != columns[:, :-1]).any(0)) + 1).tolist(), batch.num_rows]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                yield tuple(columns[:, a].tolist()), batch.slice(a, b - a)


def matrix(column: pa.Array, dims: int) -> np.ndarray:
    """A list column of equal lengths as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), dims)
