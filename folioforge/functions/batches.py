"""Arrow batches in pieces, so that what Python makes of them at once is bounded by rows and bytes, not by Spark's batch."""

from __future__ import annotations

from collections.abc import Iterator

#: Rows and bytes of a piece.
ROWS, BYTES = 256, 4 << 20


def pieces(batches: Iterator, rows: int = ROWS, size: int = BYTES) -> Iterator:
    """The same rows in the same order, at most ``rows`` at once and some ``size`` bytes, one row at least."""
    for batch in batches:
        step = max(1, min(rows, size * batch.num_rows // max(1, batch.nbytes)))
        for at in range(0, max(1, batch.num_rows), step):
            yield batch.slice(at, step)
