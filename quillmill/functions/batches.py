"""Batches of rows in Python workers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa


def pieces(batch: pa.RecordBatch, size: np.ndarray, most: int) -> Iterator[pa.RecordBatch]:
    """A batch in pieces of at most ``most`` units and one row more; size: the units of each row."""
    if batch.num_rows:
        cuts = np.flatnonzero(np.diff((np.cumsum(size) - size) // most)) + 1
        for at, end in zip([0, *cuts.tolist()], [*cuts.tolist(), batch.num_rows]):
            yield batch.slice(at, end - at)
