"""Columns of vectors as exact whole numbers: what the operators on embeddings share. numpy inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

#: Largest magnitude of a whole number that every float64 sum and product here keeps exact.
EXACT = 1 << 53


def whole_vectors(batches: Iterator, dims: int, scale: int, shift: int = 0, rows: int = 4096) -> Iterator:
    """(ids, x) for batches of (id, vector): x = floor(scale * c) + shift for each component c as double.

    Rows whose vector is null, has another length than dims, or holds null or non-finite components fall away. x is
    int64, or an object array of Python integers where a value doesn't fit 62 bits.
    """
    import numpy as np
    import pyarrow as pa

    from .common import slices

    for batch in slices(batches, rows):
        vectors = batch.column(1).cast(pa.list_(pa.float64()))
        sizes = np.diff(vectors.offsets.to_numpy())
        inner = vectors.values.slice(vectors.offsets[0].as_py(), int(sizes.sum()))
        flat = inner.to_numpy(zero_copy_only=False)  # nulls are NaN here
        there = np.asarray(vectors.is_valid()) & (sizes == dims)
        starts = np.cumsum(sizes) - sizes
        c = flat[starts[there][:, None] + np.arange(dims)] if there.any() else np.zeros((0, dims))
        good = np.isfinite(c).all(axis=1)
        ids = batch.column(0).filter(pa.array(there)).filter(pa.array(good))
        with np.errstate(over="ignore"):
            y = np.floor(c[good] * scale)
        if not len(y):
            continue
        if np.abs(y).max() < 2.0**61:
            x = y.astype(np.int64) + shift
        else:  # scaled by whole numbers: a product beyond the doubles is still a whole number
            x = np.array([[int(v) * scale + shift if abs(v) >= 2.0**53 else int(np.floor(v * scale)) + shift for v in row] for row in c[good].tolist()], object)
        yield ids, x


def common_length(df, column: str) -> int:
    """The most frequent length of a column's vectors, the larger of equally frequent ones; 0 without any."""
    from pyspark.sql import functions as F

    n = F.size(column)
    first = df.filter(F.col(column).isNotNull()).select(n.alias("n")).filter("n > 0").groupBy("n").count().orderBy(F.desc("count"), F.desc("n")).first()
    return first["n"] if first else 0
