"""Centroid clustering of whole-number vectors with screening by block norms.

A vector x is kept beside a compressed copy y of one byte a component, and the norms of the segments of r = x - y. For a centroid
c, Cauchy-Schwarz in each segment gives x.c <= y.c + sum of |r_s||c_s|, so |x|^2 + |c|^2 - 2(y.c + sum of |r_s||c_s|) is a lower
bound of the squared distance. The centroid of the smallest bound is compared first; of the others only those whose bound is not
above that distance. Bounds are in double precision with a margin for its errors; distances are exact integers.

A round is one pass over the written vectors. Each task adds up its own rows, so a row per centroid and task is shuffled, and the
driver holds the centroids only: their number and length are parameters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.llm.shared import drop_table, written
from tallystream.llm.whole_vectors import matrix, summed, whole_vectors

#: Components of a segment; rows that are screened at once.
SEGMENT, STEP = 4, 8192


def _segment_squares(x: np.ndarray) -> np.ndarray:
    """Squared norms of the segments of each row; the last segment may be shorter."""
    return np.add.reduceat(x * x, np.arange(0, x.shape[1], SEGMENT), axis=1)


def compressed(x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(codes of one byte, shift of each row, squared segment norms of what the codes leave): y = code << shift."""
    most = np.maximum(np.abs(x).max(axis=1, initial=0), 1)
    shift = np.maximum(np.ceil(np.log2(most + 1)).astype(np.int64) - 7, 0)
    codes = x >> shift[:, None]
    return codes.astype(np.int8), shift, _segment_squares(x - (codes << shift[:, None]))


class Screen:
    """Nearest centroids of vectors, and how many exact distances that took."""

    def __init__(self, centroids: list[list[int]]):
        self.c = np.array(centroids, dtype=np.int64)
        self.square = (self.c * self.c).sum(axis=1)
        self.norms = np.sqrt(_segment_squares(self.c).astype(np.float64))
        self.exact = 0

    def nearest(self, x: np.ndarray, codes: np.ndarray, shift: np.ndarray, rest: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(number, squared distance) of the nearest centroid of each row, the smaller number on ties."""
        y = codes.astype(np.float64) * np.exp2(shift)[:, None]
        total = (x * x).sum(axis=1).astype(np.float64)[:, None] + self.square.astype(np.float64)
        reach = y @ self.c.T.astype(np.float64) + np.sqrt(rest.astype(np.float64)) @ self.norms.T
        low = total - 2 * reach - total * (x.shape[1] + 32) * 2.0**-50 - 1
        first = low.argmin(axis=1)
        best = ((x - self.c[first]) ** 2).sum(axis=1)
        row, number = np.nonzero(low <= best[:, None])
        distance = ((x[row] - self.c[number]) ** 2).sum(axis=1)
        self.exact += len(x) + len(row)
        if not len(x):
            return first, best
        starts = np.searchsorted(row, np.arange(len(x)))  # each row has its first one at least
        best = np.minimum.reduceat(distance, starts)
        hit = np.flatnonzero(distance == best[row])
        _, at = np.unique(row[hit], return_index=True)
        return number[hit[at]], best


def _compress(dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            codes, shift, rest = compressed(matrix(batch.column(1), dim))
            segments = pa.ListArray.from_arrays(pa.array(np.arange(0, rest.size + 1, rest.shape[1]), pa.int32()), pa.array(rest.reshape(-1), pa.int64()))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(shift, pa.int32()), segments], ["id", "whole", "codes", "shift", "rest"])

    return run


def _parts(batch: pa.RecordBatch, dim: int) -> Iterator[tuple[slice, tuple[np.ndarray, ...]]]:
    names = batch.schema.names
    column = lambda name: batch.column(names.index(name))
    for start in range(0, batch.num_rows, STEP):
        at = slice(start, min(start + STEP, batch.num_rows))
        cut = lambda name: column(name).slice(at.start, at.stop - at.start)  # noqa: E731, B023
        codes = np.frombuffer(b"".join(cut("codes").to_pylist()), dtype=np.int8).reshape(-1, dim)
        yield at, (matrix(cut("whole"), dim), codes, cut("shift").to_numpy().astype(np.int64), matrix(cut("rest"), -(-dim // SEGMENT)))


def _sums(centroids: list[list[int]], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen, n, sums = Screen(centroids), np.zeros(len(centroids), dtype=np.int64), np.zeros((len(centroids), dim), dtype=np.int64)
        for batch in batches:
            for _, part in _parts(batch, dim):
                number, _ = screen.nearest(*part)
                n += np.bincount(number, minlength=len(n))
                sums += summed(part[0], number, len(n))
        some = np.flatnonzero(n)
        if len(some):
            yield pa.RecordBatch.from_arrays([pa.array(some, pa.int32()), pa.array(n[some]), pa.array(list(sums[some]), pa.list_(pa.int64()))], ["cluster", "n", "sums"])

    return run


def _assign(centroids: list[list[int]], dim: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        screen = Screen(centroids)
        for batch in batches:
            for at, part in _parts(batch, dim):
                number, distance = screen.nearest(*part)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at.start, at.stop - at.start), pa.array(number, pa.int32()), pa.array(distance, pa.int64())], ["id", "cluster", "distance"])

    return run


@dataclass(frozen=True)
class Clustering:
    """``rows`` (id, cluster, distance), a written table, and the final centroids."""

    rows: DataFrame
    centroids: list[list[int]]


def cluster_vectors(rows: DataFrame, k: int = 40, rounds: int = 5, *, dim: int = 64, salt: str = "2", key: str = "vec_id", vector: str = "embedding") -> Clustering:
    """Cluster the vectors of exactly ``dim`` components as whole numbers floor(256 x).

    Centroids start as the ``k`` vectors (all, if fewer) of the smallest SHA-256 of ``salt:key``; on equal keys the smaller vector
    comes first, and null keys come last. Each round assigns every vector to the nearest centroid (squared distance; the smaller
    number on ties) and replaces each centroid that has vectors by the floor of their mean; others stay. A last assignment gives
    the result, a row per vector kept; repeated rows are rows of their own. Left out: vectors that are null, have another length,
    null or non-finite components, or components whose distances would not fit a long (beyond about 740,000 at 64). A null key
    stays null. Other columns are not read. An empty table gives no rows and no centroids.
    """
    if k < 1 or rounds < 0:
        raise ValueError("there is at least one centroid")
    whole = whole_vectors(rows, vector, dim, {"id": key})
    mark = F.sha2(F.concat(F.lit(f"{salt}:"), F.col("id").cast("string")).cast("binary"), 256)
    centroids = [list(r["whole"]) for r in whole.select(mark.alias("mark"), "whole").orderBy(F.asc_nulls_last("mark"), "whole").limit(k).collect()]  # k rows
    kinds = whole.schema["id"].dataType.simpleString()
    if not centroids:
        return Clustering(rows.sparkSession.createDataFrame([], f"id {kinds}, cluster int, distance long"), [])
    table = written(whole.mapInArrow(_compress(dim), f"id {kinds}, whole array<int>, codes binary, shift int, rest array<long>"), "compressed")
    for _ in range(rounds):
        parts = table.drop("id").mapInArrow(_sums(centroids, dim), "cluster int, n long, sums array<long>")
        found = parts.groupBy("cluster").agg(F.sum("n").alias("n"), *[F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(dim)]).collect()  # k rows
        for r in found:
            centroids[r["cluster"]] = [r[f"s{i}"] // r["n"] for i in range(dim)]
    out = written(table.mapInArrow(_assign(centroids, dim), f"id {kinds}, cluster int, distance long"), "clusters")
    drop_table(table)
    return Clustering(out, centroids)
