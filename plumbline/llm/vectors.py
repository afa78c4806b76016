"""What the operators on embeddings share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(column: str) -> Column:
    """Whether a vector is not null and all its components are finite numbers."""
    finite = F.forall(column, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(F.col(column).isNotNull() & (F.size(column) > 0) & finite, F.lit(False))


def matrices(column: pa.Array, dtype: type) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, matrix) of a list column for each length of its lists; none is null."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    offsets = column.offsets.to_numpy()
    lengths, values = np.diff(offsets), column.values.to_numpy(zero_copy_only=False)
    for n in np.unique(lengths):
        rows = np.flatnonzero(lengths == n)
        yield rows, values[offsets[rows][:, None] + np.arange(n)].astype(dtype)


def unit(matrix: np.ndarray) -> np.ndarray:
    """Rows of length 1, in double precision; the largest component is divided out first."""
    matrix = matrix.astype(np.float64)
    matrix = matrix / np.abs(matrix).max(axis=1, keepdims=True)
    return matrix / np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))


def sample_matrices(rows: DataFrame, column: str, most: int) -> dict[int, np.ndarray]:
    """At most `most` vectors, those with the smallest hashes, by their number of components. Bounded, on the driver."""
    found = rows.select(column).orderBy(F.xxhash64(column), column).limit(most).toArrow()
    return {m.shape[1]: m for _, m in matrices(found.column(0), np.float64)} if found.num_rows else {}


def spread(matrix: np.ndarray, most: int, at_most_cosine: float) -> np.ndarray:
    """Up to `most` rows of a matrix of unit rows, none with a greater cosine to an earlier one."""
    kept: list[np.ndarray] = []
    for row in matrix:
        if len(kept) == most:
            break
        if not kept or (np.array(kept) @ row).max() <= at_most_cosine:
            kept.append(row)
    return np.array(kept).reshape(-1, matrix.shape[1])


def runs(keys: list[list]) -> Iterator[tuple[tuple, int, int]]:
    """(key, begin, end) of runs of equal keys in parallel lists."""
    rows, begin = list(zip(*keys, strict=True)), 0
    for i in range(1, len(rows) + 1):
        if i == len(rows) or rows[i] != rows[begin]:
            yield rows[begin], begin, i
            begin = i


def array_type(df: DataFrame, column: str) -> str:
    """The SQL type of a vector column: array<float> or else array<double>."""
    return "array<float>" if dict(df.dtypes)[column] == "array<float>" else "array<double>"
