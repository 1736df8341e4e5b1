"""Helpers of the vector operators: rows that take part, blocks of rows, matrices of Arrow lists."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def usable(vector: str) -> Column:
    """True where the vector isn't null and all its components are finite numbers."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.col(vector).isNotNull() & F.coalesce(fine, F.lit(False))


def n_blocks(df: DataFrame, rows: int) -> int:
    """Blocks of about ``rows`` rows that ``df`` makes, 1 at least."""
    return max(1, math.ceil(df.count() / rows))


def block(df: DataFrame, name: str, blocks: int, *keys: str) -> DataFrame:
    """``df`` with a block number drawn from the keys' hash."""
    return df.withColumn(name, F.pmod(F.xxhash64(*keys), F.lit(blocks)).cast("int"))


def to_all(df: DataFrame, name: str, blocks: int) -> DataFrame:
    """``df`` once for each block of the other side."""
    return df.withColumn(name, F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))


def matrix(column, dtype) -> np.ndarray:
    """Rows of a list column; shorter ones are filled up with zeros."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    n = len(column)
    if not n:
        return np.zeros((0, 0), dtype)
    off = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)[off[0]:off[-1]].astype(dtype, copy=False)
    size = np.diff(off)
    width = int(size.max())
    if (size == width).all():
        return values.reshape(n, width)
    out = np.zeros((n, width), dtype)
    out[np.repeat(np.arange(n), size), np.arange(len(values)) - np.repeat(off[:-1] - off[0], size)] = values
    return out


def widened(a: np.ndarray, width: int) -> np.ndarray:
    return a if a.shape[1] == width else np.pad(a, ((0, 0), (0, width - a.shape[1])))


def first_of_each(group: np.ndarray, most: int) -> np.ndarray:
    """True at the first ``most`` places of each run of equal values."""
    if not len(group):
        return np.zeros(0, bool)
    new = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
    return np.arange(len(group)) - np.repeat(new, np.diff(np.append(new, len(group)))) < most
