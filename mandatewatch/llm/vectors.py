"""Vectors as rows for numpy: which ones count, and their bytes."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(rows: DataFrame, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(vec_id, v) of the vectors that take part, v as array<double>.

    Left out: null ids, null, empty or zero vectors, and those with a null or
    non-finite component. Cosine needs equal lengths, so callers compare within one
    length, for every length in turn.
    """
    v = F.transform(F.col(vector), lambda x: x.cast("double"))
    own = rows.select(F.col(key).cast("long").alias("vec_id"), v.alias("v")).filter("vec_id is not null")
    finite = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return own.filter(F.col("v").isNotNull() & (F.size("v") > 0) & F.coalesce(finite, F.lit(False)) & F.exists("v", lambda x: x != 0.0))


def lengths_of(good: DataFrame) -> list[int]:
    """The vector lengths that occur; each is worked on by itself."""
    return sorted(r.n for r in good.select(F.size("v").alias("n")).distinct().collect())


def matrix(column) -> np.ndarray:
    """An Arrow column of lists of equal length as a matrix."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.empty((0, 0))


def units(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1; first by their largest component, so that squares neither overflow nor vanish."""
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


def cosines(query: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Cosine of one original vector with each original row, in double precision.

    Row-wise sums, so that equal rows get equal numbers wherever they stand.
    """
    q = query / np.abs(query).max()
    x = rows / np.abs(rows).max(axis=1, keepdims=True)
    return (x * q).sum(axis=1) / (np.sqrt((x * x).sum(axis=1)) * np.sqrt((q * q).sum()))
