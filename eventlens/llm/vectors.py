"""Whole-number vectors: rows that hold finite numbers only, as matrices of exact integers inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Bytes of the integers that a task works on at a time.
BYTES = 1 << 22
#: Scaled components beyond this count as this; the largest long, which stands for all distances beyond it.
EDGE, LONG = 2**62, 2**63 - 1


def finite(df: DataFrame, vec_col: str) -> DataFrame:
    """The rows whose vector is neither null nor holds a null, NaN or infinite component; components as float or double."""
    kind = df.schema[vec_col].dataType
    if not (isinstance(kind, T.ArrayType) and isinstance(kind.elementType, (T.FloatType, T.DoubleType))):
        df = df.withColumn(vec_col, quoted(vec_col).cast("array<double>"))
    good = F.forall(quoted(vec_col), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return df.where(quoted(vec_col).isNotNull() & good)


def quoted(name: str) -> Column:
    return F.col("`" + name.replace("`", "``") + "`")


def scaled(values: np.ndarray, scale: int) -> np.ndarray:
    """floor(scale * x) of doubles, exact for scales that are powers of two, kept within EDGE."""
    return np.clip(np.floor(values.astype(np.float64) * scale), -float(EDGE), float(EDGE)).astype(np.int64)


def matrices(column: pa.Array, dims: int, scale: int) -> Iterator[tuple[int, np.ndarray]]:
    """(first row, integers) of pieces of a column of whole vectors of `dims` components."""
    flat, n = column.flatten().to_numpy(zero_copy_only=False), len(column)
    step = max(1, BYTES // (8 * max(1, dims)))
    for at in range(0, n, step):
        rows = min(step, n - at)
        yield at, scaled(flat[at * dims : (at + rows) * dims], scale).reshape(rows, dims)


def limit(dims: int) -> int:
    """Components up to this keep all squared distances within a long."""
    return 1 << max(0, (62 - max(1, dims).bit_length()) // 2 - 1)


def pairwise(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Exact squared distances of every row to every entry; Python's integers where a long could overflow."""
    most = max((int(np.abs(a).max()) if a.size else 0) for a in (x, c))
    if most > limit(x.shape[1]):
        x, c = x.astype(object), c.astype(object)
    return ((x[:, None, :] - c[None]) ** 2).sum(axis=2)


class Sums:
    """Counts and exact component sums of groups of integer rows, in two halves of 32 bits that can't overflow."""

    def __init__(self, groups: int, dims: int):
        self.n = np.zeros(groups, np.int64)
        self.high, self.low = np.zeros((groups, dims), np.int64), np.zeros((groups, dims), np.int64)

    def add(self, x: np.ndarray, group: np.ndarray) -> None:
        if not len(x):
            return
        order = np.argsort(group, kind="stable")
        own, first = np.unique(group[order], return_index=True)
        self.n += np.bincount(group, minlength=len(self.n))
        self.high[own] += np.add.reduceat(x[order] >> 32, first, axis=0)
        self.low[own] += np.add.reduceat(x[order] & 0xFFFFFFFF, first, axis=0)


def total(name: str) -> Column:
    return F.sum(F.col(name).cast("decimal(20,0)")).alias(name)


def long_sum(name: str) -> Column:
    """A sum of longs as a long; sums beyond it are the largest one."""
    return F.least(F.sum(F.col(name).cast("decimal(20,0)")), F.lit(LONG).cast("decimal(38,0)")).cast("bigint")
