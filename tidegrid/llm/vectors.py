"""What the two operators on embeddings share."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: Column) -> Column:
    """Whether a vector is not null, has no null or non-finite component and is not zero."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return F.coalesce(vector.isNotNull() & fine & F.exists(vector, lambda x: x != 0), F.lit(False))


def squared_norm(vector: Column) -> Column:
    return F.aggregate(vector, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))


def matrix(column: pa.Array | pa.ChunkedArray, width: int) -> np.ndarray:
    """Vectors of one width as rows in double precision."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.astype(np.float64).reshape(-1, width)


def directions(count: int, width: int, seed: int) -> np.ndarray:
    """Random directions of unit length, one a column; the same for the same arguments everywhere."""
    drawn = np.random.default_rng([seed, width]).normal(size=(width, count))
    return drawn / np.linalg.norm(drawn, axis=0)


def blocks(df: DataFrame, most: int) -> int:
    """How many blocks of about `most` rows df makes."""
    return max(1, -(-df.count() // most))
