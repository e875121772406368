"""Rows of vectors as matrices, for the operators on embeddings."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def dimension(rows: DataFrame, column: str = "embedding") -> int:
    """The length that most vectors have, of equal counts the greatest; 0 if there is no vector."""
    sizes = rows.where(F.col(column).isNotNull()).groupBy(F.size(column).alias("length")).agg(F.count(F.lit(1)).alias("times"))
    most = sizes.orderBy(F.desc("times"), F.desc("length")).limit(1).collect()
    return most[0].length if most else 0


def matrix(column: pa.Array, d: int) -> tuple[np.ndarray, np.ndarray]:
    """Which rows hold d entries, none of them null or not finite, and these rows as doubles."""
    if pa.types.is_fixed_size_list(column.type):
        column = column.cast(pa.list_(column.type.value_type))
    lengths = column.value_lengths().fill_null(-1).to_numpy(zero_copy_only=False)
    flat = pc.fill_null(column.flatten().cast(pa.float64()), float("nan")).to_numpy(zero_copy_only=False)
    fits = lengths == d
    found = flat[np.repeat(fits, np.maximum(lengths, 0))].reshape(-1, d)
    finite = np.isfinite(found).all(axis=1)
    good = fits.copy()
    good[fits] = finite
    return good, found[finite]


def floored(x: np.ndarray, scale: int, limit: int) -> np.ndarray:
    """floor(scale * x) as whole numbers, none beyond limit in size."""
    return np.clip(np.floor(scale * x), -limit, limit).astype(np.int64)


def limit_of(d: int, bits: int) -> int:
    """The greatest size of entries whose products, d of them added up, stay below 2 to the power of bits."""
    return int(np.sqrt(2.0**bits / max(d, 1)))
