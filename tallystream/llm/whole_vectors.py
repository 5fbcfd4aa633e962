"""Vectors of whole numbers, which distances are exact on, and sums of them by group."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: A component x becomes floor(SCALE * x).
SCALE = 256


def bound(dim: int) -> int:
    """The largest magnitude of components for which every squared distance of ``dim`` of them fits a long."""
    return math.isqrt(((1 << 63) - 1) // dim) // 2


def finite(vector: Column) -> Column:
    """Not null, and no component is null or not finite."""
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x.cast("double")) == float("inf")))
    return F.coalesce(vector.isNotNull() & ~odd, F.lit(False))


def whole_vectors(rows: DataFrame, vector: str, dim: int, keep: dict[str, str]) -> DataFrame:
    """(columns of ``keep`` by their new names, whole): finite vectors of ``dim`` components as whole numbers.

    Vectors with a component beyond ``bound(dim)`` after scaling are left out, as their distances would not fit a long.
    """
    most = bound(dim)
    scaled = F.transform(F.col(vector), lambda x: F.floor(x.cast("double") * SCALE))
    small = F.forall(F.col(vector), lambda x: F.abs(x.cast("double") * SCALE) < most)
    fit = finite(F.col(vector)) & (F.size(vector) == dim) & small
    return rows.filter(fit).select(*[F.col(old).alias(new) for new, old in keep.items()], F.transform(scaled, lambda x: x.cast("int")).alias("whole"))


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """Lists of ``dim`` numbers without nulls as the rows of a matrix."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(-1, dim)


def summed(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Exact sums of the rows of ``values`` by their group."""
    out = np.zeros((groups, values.shape[1]), dtype=np.int64)
    order = np.argsort(group, kind="stable")
    own, starts = np.unique(group[order], return_index=True)
    if len(own):
        out[own] = np.add.reduceat(values[order], starts, axis=0)
    return out
