"""Vectors for the searches: which rows take part, and blocks of them."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

QUERY_MODULUS = 20


def usable(rows: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding") -> DataFrame:
    """(vec_id long, x array<double>): rows with an id and a vector without null or non-finite components.

    Rows that repeat an id count once; if their vectors differ, the smallest of them, component
    by component, counts. An empty vector has no components that could be wrong and takes part.
    """
    def finite(v: Column) -> Column:
        return F.coalesce(v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf")), F.lit(False))

    x = F.col(embedding).cast("array<double>")
    good = rows.where(F.col(vec_id).isNotNull()).select(F.col(vec_id).cast("long").alias("vec_id"), x.alias("x")).where(
        F.col("x").isNotNull() & F.forall("x", finite))
    return good.groupBy("vec_id").agg(F.min("x").alias("x"))


def is_query(vec_id: Column) -> Column:
    return vec_id % QUERY_MODULUS == 0


def matrix(column: pa.ListArray | pa.ChunkedArray, width: int | None = None) -> np.ndarray:
    """Rows of numbers as one matrix; shorter rows are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    sizes = np.diff(column.offsets.to_numpy())
    width = max(width or 0, sizes.max(initial=0))
    out = np.zeros((len(sizes), width), dtype=column.type.value_type.to_pandas_dtype())
    flat = column.flatten().to_numpy(zero_copy_only=False)
    row = np.repeat(np.arange(len(sizes)), sizes)
    out[row, np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = flat
    return out


def same_width(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    width = max(a.shape[1], b.shape[1])
    return tuple(np.pad(x, ((0, 0), (0, width - x.shape[1]))) for x in (a, b))


def best(row: np.ndarray, score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of each row's k highest scores, ties to smaller ids."""
    order = np.lexsort((ids, -score, row))
    row = row[order]
    nth = np.arange(len(row)) - np.searchsorted(row, row, side="left")
    return order[nth < k]
