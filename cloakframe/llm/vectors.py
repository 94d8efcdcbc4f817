"""What the operators on vectors share: which vectors count, and repeated ids."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def usable(column: str):
    """Not null or empty, no null or non-finite component, not all zero."""
    v = F.col(column)
    finite = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return v.isNotNull() & (F.size(v) > 0) & F.coalesce(finite, F.lit(False)) & F.exists(v, lambda x: x != 0)


def repeated(df: DataFrame, key: str) -> bool:
    """Do rows repeat a key?"""
    return bool(df.select(F.col(key).cast("long").alias(key)).where(F.col(key).isNotNull()).groupBy(key).count().where("count > 1").take(1))


def one_row_each(df: DataFrame, key: str, value: str, narrow: bool = False) -> DataFrame:
    """key, value with one row for each key: of repeated rows, the least value. Rows without a key go.

    Values are arrays of doubles; `narrow` leaves floats as they are.
    """
    kind = "array<float>" if narrow and df.schema[value].dataType.simpleString() == "array<float>" else "array<double>"
    again = repeated(df, key)
    df = df.select(F.col(key).cast("long").alias(key), F.col(value).cast(kind).alias(value)).where(F.col(key).isNotNull())
    if not again:
        return df
    return df.groupBy(key).agg(F.min(value).alias(value))


def by_dimension(ids: pa.Array, vectors: pa.Array):
    """(row numbers, matrix) for each dimension in a batch of usable vectors."""
    sizes = np.array(vectors.value_lengths())
    flat = np.array(vectors.flatten(), np.float64)
    begin = np.cumsum(sizes) - sizes
    for d in np.unique(sizes):
        rows = np.flatnonzero(sizes == d)
        yield int(d), rows, flat[begin[rows][:, None] + np.arange(d)]


def random_matrix(seed: int, rows: int, columns: int) -> np.ndarray:
    return np.random.Generator(np.random.PCG64([seed, rows, columns])).normal(size=(rows, columns))
