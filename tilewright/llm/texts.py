"""Texts as Arrow batches."""

from __future__ import annotations

import numpy as np

#: Bytes of text that a Python worker takes at once.
PIECE = 1 << 20


def slices(batch, column: int, rows: int | None = None, most: int = PIECE):
    """Parts of a batch with at most `most` bytes of text in that column (and so many rows), or a single longer one."""
    import pyarrow.compute as pc

    size, at = np.cumsum(pc.binary_length(batch.column(column)).to_numpy()), 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + most, "right")))
        to = min(to, at + rows) if rows else to
        yield batch.slice(at, to - at)
        at = to
