"""Vectors of Arrow batches as numpy matrices: what the operators on embeddings share inside their tasks."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import types as T

from llm.shared import plain


def doubles(frame: DataFrame, name: str) -> Column:
    """The vector column as it is if it holds floats or doubles, else cast to doubles; what cannot be cast is null."""
    column, kind = plain(name), frame.schema[name].dataType
    if isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType)):
        return column
    if isinstance(kind, T.ArrayType):
        return column.try_cast("array<double>")
    raise ValueError(f"{name} holds {kind.simpleString()}, not vectors")


def finite(column: pa.Array) -> list[tuple[np.ndarray, np.ndarray]]:
    """Of an Arrow list column the vectors that are not null and hold only finite entries, by length: (places of the rows,
    matrix of doubles)."""
    offsets = column.offsets.to_numpy()
    sizes = np.diff(offsets)
    values = column.values.to_numpy(zero_copy_only=False).astype(np.float64)  # null entries come as NaN
    bad = np.concatenate([[0], np.cumsum(~np.isfinite(values))])
    kept = (bad[offsets[1:]] == bad[offsets[:-1]]) & column.is_valid().to_numpy(zero_copy_only=False)
    out = []
    for size in np.unique(sizes[kept]):
        rows = np.flatnonzero(kept & (sizes == size))
        out.append((rows, values[offsets[:-1][rows, None] + np.arange(size)]))
    return out
