"""Arrow <-> NumPy for array columns: whole batches as matrices, without Python objects per spectrum."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

Kernel = Callable[[np.ndarray], np.ndarray]


def widths(column: pa.Array) -> np.ndarray:
    """Length of every list; -1 for NULL."""
    offsets = column.offsets.to_numpy()
    n = np.diff(offsets)
    return np.where(np.asarray(column.is_valid()), n, -1)


def as_lists(column: pa.Array | pa.ChunkedArray) -> pa.ListArray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column


def matrix(column: pa.ListArray, rows: np.ndarray, width: int) -> np.ndarray:
    """The given rows (all of one width) as a float matrix; NULL channels become NaN."""
    values = column.values.to_numpy(zero_copy_only=False).astype(float, copy=False)
    starts = column.offsets.to_numpy()[rows]
    if len(rows) and width and (np.diff(starts) == width).all():
        return values[starts[0] : starts[0] + len(rows) * width].reshape(len(rows), width)
    return values[starts[:, None] + np.arange(width)]


def from_matrix(x: np.ndarray) -> pa.ListArray:
    """A float matrix as an Arrow list column."""
    x = np.ascontiguousarray(x, dtype=float)
    offsets = np.arange(0, x.size + 1, x.shape[1], dtype=np.int32) if x.shape[1] else np.zeros(len(x) + 1, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(x.ravel()))


def apply_kernel(column: pa.Array | pa.ChunkedArray, kernel: Kernel) -> pa.Array:
    """*kernel* over the spectra of a batch, one call per spectrum width; NULL stays NULL."""
    lists = as_lists(column)
    n = widths(lists)
    found = np.unique(n)
    if len(found) == 1 and found[0] >= 0:
        return from_matrix(kernel(matrix(lists, np.arange(len(lists)), int(found[0]))))
    out: list = [None] * len(lists)
    for width in found[found >= 0]:
        rows = np.flatnonzero(n == width)
        for r, y in zip(rows, kernel(matrix(lists, rows, int(width)))):
            out[r] = y
    return pa.array(out, type=pa.list_(pa.float64()))


def kernel_column(x: str | Column, kernel: Kernel) -> Column:
    """A column expression that runs *kernel* on Arrow batches of an array column."""

    @F.arrow_udf("array<double>")
    def run(column: pa.Array) -> pa.Array:
        return apply_kernel(column, kernel)

    return run(x)


def chain(kernels: list[Kernel]) -> Kernel:
    """Consecutive kernels fused into one, so a spectrum crosses the JVM boundary once."""

    def fused(x: np.ndarray) -> np.ndarray:
        for k in kernels:
            x = k(x)
        return x

    return fused
