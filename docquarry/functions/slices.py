"""Python column functions and batches in slices: a worker holds a batch of its input, but the objects and results of a slice alone."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

#: Bytes of a slice, about; a longer row stands alone.
SLICE = 1 << 20


def slices(column: pa.Array, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows that hold about `most` bytes each."""
    n = len(column)
    if not n:
        return
    if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) or pa.types.is_binary(column.type) or pa.types.is_large_binary(column.type):
        size = pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False)
    elif pa.types.is_list(column.type) or pa.types.is_large_list(column.type):
        inner = column.flatten()
        size = pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False) * (inner.nbytes / max(1, len(inner)))
    else:
        size = np.full(n, column.nbytes / n)
    ends = np.cumsum(size + 16)  # what a row takes at least
    a, done = 0, 0.0
    while a < n:
        b = max(a + 1, int(np.searchsorted(ends, done + most, "right")))
        yield a, b
        a, done = b, ends[b - 1]


def each(one: Callable, kind: T.DataType, most: int = SLICE):
    """Column function: one(value) of each row."""
    arrow = to_arrow_type(kind)

    @F.arrow_udf(kind)
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for a, b in slices(column, most):
                yield pa.array([one(x) for x in column[a:b].to_pylist()], arrow)

    return run
