"""Vector columns in Arrow batches, and columns taken by position."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def taken(df: DataFrame, **wanted: str) -> DataFrame:
    """new = name: the columns named, under new names; other columns, whatever they are called, go."""
    at = {new: df.columns.index(name) for new, name in wanted.items()}
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[F.col(f"c{i}").alias(new) for new, i in at.items()])


def finite(vec: Column) -> Column:
    """Whether a vector is there and all of its components are finite numbers."""
    whole = F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vec.isNotNull() & whole, F.lit(False))


def floats(column: pa.Array | pa.ChunkedArray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, float64 matrix) of a list column without nulls, once for each length of list."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    starts = column.offsets.to_numpy()
    flat = column.values.to_numpy(zero_copy_only=False).astype(np.float64, copy=False)
    lengths = np.diff(starts)
    for n in np.unique(lengths):
        rows = np.nonzero(lengths == n)[0]
        yield rows, flat[starts[rows][:, None] + np.arange(n)] if n else np.zeros((len(rows), 0))


def matrix(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """The lists of a column, all of one length, as a float64 matrix."""
    for _, out in floats(column):
        return out
    return np.zeros((0, 0))


def ids_of(column: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A bigint column as numbers that sort null last."""
    return column.fill_null(2**63 - 1).to_numpy(zero_copy_only=False) if isinstance(column, pa.Array) else ids_of(column.combine_chunks())


def scaled(m: np.ndarray) -> np.ndarray:
    """Each row times a power of two that brings its largest component near 1: exact, and squares stay finite."""
    top = np.abs(m).max(axis=1, initial=0.0)
    return np.ldexp(m, -np.frexp(np.where(top > 0, top, 1.0))[1][:, None])


def lengths_of(m: np.ndarray) -> np.ndarray:
    return np.sqrt((m * m).sum(axis=1))
