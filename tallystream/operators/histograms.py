"""Rows as one byte a feature, and rows that are alike in all bytes and their label as one group with counts.

What a tree asks of a row follows from its bins and its label, but for how often the row is drawn. So draws are added up by group,
and trees are grown on groups: of a few features there are no more than their bins can be combined, however many rows there are.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Rows of a task that are grouped at a time.
ROWS = 1 << 20
#: Share of the rows that a quantile's place may be off.
OFF = 1e-4


def edges_of(df: DataFrame, features: dict[str, Column], bins: int) -> list[list[float]]:
    """Per feature at most ``bins`` - 1 rising values that rows are cut at; a row belongs to the first that it is not above. Quantiles
    from one pass over all rows, exact below some thousands of rows."""
    safe = df.select(*[F.when(~F.isnan(c.cast("double")), c.cast("double")).alias(f"f{i}") for i, c in enumerate(features.values())])
    found = safe.approxQuantile([f"f{i}" for i in range(len(features))], [i / bins for i in range(1, bins)], OFF)
    return [sorted(set(values)) for values in found]


def few_values(df: DataFrame, features: dict[str, Column], most: int) -> dict[int, list[float]]:
    """The values of those features that have no more than ``most`` distinct ones, by their place."""

    size = len(features)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: list[np.ndarray] = [np.empty(0)] * size
        for batch in batches:
            for i, known in enumerate(found):
                if len(known) <= most:
                    x = batch.column(i).to_numpy(zero_copy_only=False).astype(float)
                    found[i] = np.unique(np.concatenate([known, x[~np.isnan(x)] + 0.0]))[: most + 1]
        for i, known in enumerate(found):
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(known), i), pa.int32()), pa.array(known, pa.float64())], ["feature", "value"])

    values = df.select(*[c.cast("double").alias(f"f{i}") for i, c in enumerate(features.values())]).mapInArrow(run, "feature int, value double").distinct()
    few = values.groupBy("feature").agg(F.count("*").alias("n"), F.collect_list("value").alias("values")).select("feature", F.when(F.col("n") <= most, F.sort_array("values")).alias("values"))
    return {r["feature"]: r["values"] for r in few.collect() if r["values"] is not None}  # a row per feature


def bins_of(batch: pa.RecordBatch, n: int) -> np.ndarray:
    """The column ``bins`` as (rows, features)."""
    column = batch.column(batch.schema.get_field_index("bins"))
    wide = np.int64 if pa.types.is_large_binary(column.type) else np.int32
    _, offsets, data = column.buffers()
    at = np.frombuffer(offsets, dtype=wide)[column.offset : column.offset + len(column) + 1] if len(column) else np.zeros(1, dtype=wide)
    return np.frombuffer(data or b"", dtype=np.uint8)[at[0] : at[-1]].reshape(-1, n)


def bytes_array(x: np.ndarray) -> pa.Array:
    """A binary of each row of bytes."""
    offsets = np.arange(len(x) + 1, dtype=np.int32) * np.int32(x.shape[1])
    return pa.Array.from_buffers(pa.binary(), len(x), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(x, dtype=np.uint8))])


def bins_at(columns: list[pa.Array], edges: list[list[float]]) -> np.ndarray:
    """A byte per feature; a missing value is above all edges."""
    out = np.empty((len(columns[0]), len(edges)), dtype=np.uint8)
    for i, at in enumerate(edges):
        x = columns[i].to_numpy(zero_copy_only=False).astype(float)
        out[:, i] = np.where(np.isnan(x), len(at), np.searchsorted(np.array(at), x, side="left"))
    return out


def group_sums(rows: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct rows of bytes, and the sums of ``values`` (sums, rows) of each."""
    words = np.zeros((len(rows), -(-rows.shape[1] // 8) * 8), dtype=np.uint8)
    words[:, : rows.shape[1]] = rows
    words = words.view(np.uint64)
    by = np.argsort(words[:, 0], kind="stable") if words.shape[1] == 1 else np.lexsort(words.T)
    new = np.ones(len(rows), dtype=bool)
    new[1:] = (words[by[1:]] != words[by[:-1]]).any(axis=1)
    cuts = np.flatnonzero(new)
    return rows[by[cuts]], np.add.reduceat(values[:, by], cuts, axis=1)


def grouped(df: DataFrame, read: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]], sums: list[str]) -> DataFrame:
    """(y, bins, sums) of each group. ``read`` gives a batch's labels, bins and what is summed (sums, rows)."""

    def flushed(kept: list[tuple]) -> pa.RecordBatch:
        rows, values = group_sums(np.concatenate([k[0] for k in kept]), np.concatenate([k[1] for k in kept], axis=1))
        return pa.RecordBatch.from_arrays([pa.array(rows[:, 0].astype(np.int32)), bytes_array(rows[:, 1:]), *[pa.array(v, pa.int64()) for v in values]], ["y", "bins", *sums])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kept, size = [], 0
        for batch in batches:
            if not batch.num_rows:
                continue
            y, bins, values = read(batch)
            if not np.isin(y, (0, 1)).all():
                raise ValueError("labels are 0 or 1")
            kept.append((np.column_stack([y.astype(np.uint8), bins]), values))
            size += batch.num_rows
            if size >= ROWS:
                yield flushed(kept)
                kept, size = [], 0
        if kept:
            yield flushed(kept)

    parts = df.mapInArrow(run, ", ".join(["y int", "bins binary", *[f"{s} long" for s in sums]]))
    return parts.groupBy("y", "bins").agg(*[F.sum(s).alias(s) for s in sums])
