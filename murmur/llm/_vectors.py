"""Vector columns: which rows take part, and Arrow lists as matrices."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from murmur.llm._common import by_value, narrow

by_value(__name__)


def finite(vec: Column) -> Column:
    """Not null, and no component null, NaN or infinite."""
    return vec.isNotNull() & F.forall(
        vec, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def usable_vectors(df: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(id, vec) of rows with an id and a finite vector, as doubles."""
    return narrow(df, id=F.col(id_col).cast("long"), vec=F.col(vec_col).cast("array<double>")).where(
        F.col("id").isNotNull() & F.coalesce(finite(F.col("vec")), F.lit(False)))


def padded(vec: Column, dim: int, zero) -> Column:
    """Shorter vectors are filled up with zeros."""
    return F.when(F.size(vec) < dim, F.concat(vec, F.array_repeat(F.lit(zero), F.lit(dim) - F.size(vec)))).otherwise(vec)


def matrix(column, dim: int) -> np.ndarray:
    """A list column of equal lengths as rows of a matrix."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), dim)


def best(query: np.ndarray, score: np.ndarray, ident: np.ndarray, k: int, largest: bool):
    """Indexes of every query's k best rows; ties to smaller ids."""
    order = np.lexsort((ident, -score if largest else score, query))
    q = query[order]
    first = np.flatnonzero(np.r_[True, q[1:] != q[:-1]]) if len(q) else np.zeros(0, dtype=np.int64)
    rank = np.arange(len(q)) - np.repeat(first, np.diff(np.r_[first, len(q)]))
    return order[rank < k]
