"""Exact nearest neighbours in numbers and categories, without gathering the points.

The distance is the root of squared differences plus a penalty squared for each category that differs, which is a Euclidean one.
Cuts at medians of a sample in proportion to the points (of numbers, or of categories in their order) divide the points into cells
of about one block, so that a block is a small part of space however many points there are. A point's neighbours inside its own
block bound its distance to the last one wanted; a block is passed over if its box (the least and most of each column) lies further
away. What is left is compared in pairs of blocks, and the best are merged. Equal points are one, with as many of their numbers as a
result can need.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tallystream.sources.shared import drop_table, written

#: Cells at least; points of a block, about (twice as many at most); sampled points for each cell; points compared at once.
CELLS, BLOCK, SAMPLE, STEP = 1, 1024, 32, 64
POINT = "x array<double>, c array<string>"


def _elements(column: pa.Array | pa.ChunkedArray) -> pa.Array:
    """The elements of lists of one length, one after the other."""
    parts = [p.flatten() for p in (column.chunks if isinstance(column, pa.ChunkedArray) else [column])]
    return parts[0] if len(parts) == 1 else pa.concat_arrays(parts)


def _numbers(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    return _elements(rows["x"]).to_numpy(zero_copy_only=False).astype(float).reshape(rows.num_rows, -1)


def _categories(rows: pa.Table | pa.RecordBatch) -> np.ndarray:
    return _elements(rows["c"]).to_numpy(zero_copy_only=False).astype(object).reshape(rows.num_rows, -1)


def _codes(*sides: pa.Table) -> list[np.ndarray]:
    """The categories of several tables as numbers that are equal where these are."""
    parts = [_elements(s["c"]) for s in sides]
    codes = pa.concat_arrays(parts).dictionary_encode().indices.to_numpy(zero_copy_only=False)
    ends = np.cumsum([len(p) for p in parts])[:-1]
    return [p.reshape(s.num_rows, -1) for p, s in zip(np.split(codes, ends), sides, strict=True)]


def distances(x: np.ndarray, c: np.ndarray, y: np.ndarray, d: np.ndarray, penalty: float) -> np.ndarray:
    """Squared distances of all points of the one and the other side."""
    far = np.zeros((len(x), len(y)))
    for j in range(x.shape[1]):
        far += (x[:, None, j] - y[None, :, j]) ** 2
    for j in range(c.shape[1]):
        far += penalty**2 * (c[:, None, j] != d[None, :, j])
    return far


def _cuts(x: np.ndarray, c: np.ndarray, cells: int, penalty: float) -> tuple | int:
    """A tree of (column, value, cells up to the value, cells above it) down to numbers of cells; columns of ``c`` follow those of
    ``x``. The column that is cut is the one with the largest mean squared difference."""
    numbers = iter(range(cells))

    def cut(at: np.ndarray, cells: int) -> tuple | int:
        spreads = [*np.nan_to_num(np.nanvar(x[at], axis=0))] if len(at) else []
        for j in range(c.shape[1] if len(at) else 0):
            shares = np.unique(c[at, j], return_counts=True)[1] / len(at)
            spreads.append(penalty**2 * (1 - (shares**2).sum()) / 2)
        for j in np.argsort(spreads)[::-1] if cells > 1 and len(at) > 1 else []:
            values = x[at, j] if j < x.shape[1] else c[at, j - x.shape[1]]
            ranked = np.sort(values)
            value = ranked[len(at) * (cells // 2) // cells]
            below = values <= value
            if below.all():
                value = max((v for v in ranked if v < value), default=value)
                below = values <= value
            if 0 < below.sum() < len(at):
                left = min(cells - 1, max(1, round(cells * below.mean())))
                return int(j), value, cut(at[below], left), cut(at[~below], cells - left)
        return next(numbers)

    return cut(np.arange(len(x)), cells)


def _assigned(tree: tuple | int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, c = _numbers(batch) if batch.num_rows else None, _categories(batch) if batch.num_rows else None
            cell, open_ = np.zeros(batch.num_rows, dtype=np.int32), [(tree, np.arange(batch.num_rows))]
            while open_:
                node, at = open_.pop()
                if isinstance(node, int):
                    cell[at] = node
                elif len(at):
                    j, value, left, right = node
                    below = (x[at, j] if j < x.shape[1] else c[at, j - x.shape[1]]) <= value
                    open_ += [(left, at[below]), (right, at[~below])]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cell)], [*batch.schema.names, "cell"])

    return run


class Boxes:
    """The least and most of each column of all blocks."""

    def __init__(self, rows: list, numbers: int, categories: int):
        take = lambda name, n: [[r[f"{name}{j}"] for r in rows] for j in range(n)]
        self.number = np.array([r["block"] for r in rows])
        self.low, self.high = (np.array(take(name, numbers), dtype=float).reshape(numbers, len(rows)) for name in ("xl", "xh"))
        first, last = take("cl", categories), take("ch", categories)
        # Categories by their places among all bounds.
        self.levels = [np.array(sorted({*a, *b}), dtype=object) for a, b in zip(first, last, strict=True)]
        self.first, self.last = ([np.searchsorted(v, np.array(a, dtype=object)) for v, a in zip(self.levels, side, strict=True)] for side in (first, last))

    def away(self, low: np.ndarray, high: np.ndarray, first: list[np.ndarray], last: list[np.ndarray], at: np.ndarray, penalty: float) -> np.ndarray:
        """Lower bounds of the distances between points in the boxes given (a row each; ``first`` and ``last`` are places) and the
        blocks ``at``."""
        far = np.zeros((len(low), len(at)))
        for j in range(len(self.low)):
            far += np.maximum(np.maximum(self.low[j][at] - high[:, None, j], low[:, None, j] - self.high[j][at]), 0) ** 2
        for j in range(len(self.levels)):
            far += penalty**2 * ((self.first[j][at] > last[j][:, None]) | (self.last[j][at] < first[j][:, None]))
        return np.sqrt(far)

    def places(self, c: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """The places of the first bound not before a category and of the last one not after it."""
        found = [np.unique(c[:, j], return_inverse=True) for j in range(c.shape[1])]
        return tuple([(np.searchsorted(v, u, side=side) - less)[of] for v, (u, of) in zip(self.levels, found, strict=True)] for side, less in (("left", 0), ("right", 1)))


def _within(bound: np.ndarray) -> np.ndarray:
    """Distances up to the bound, with room for rounding."""
    return bound * (1 + 1e-9) + 1e-9


def _bounds(x: np.ndarray, c: np.ndarray, weight: np.ndarray, k: int, penalty: float) -> np.ndarray:
    """The distance within which ``k`` further members of a block lie from each of its points."""
    out = np.full(len(x), np.inf)
    for start in range(0, len(x), STEP):
        far = distances(x[start : start + STEP], c[start : start + STEP], x, c, penalty)
        some = np.argpartition(far, k, axis=1)[:, : k + 1] if len(x) > k + 1 else np.broadcast_to(np.arange(len(x)), far.shape)
        some = np.take_along_axis(some, np.argsort(np.take_along_axis(far, some, axis=1), axis=1), axis=1)
        enough = np.cumsum(weight[some], axis=1) > k  # the point itself is one of them
        rows = np.flatnonzero(enough.any(axis=1))
        out[start + rows] = far[rows, some[rows, enough[rows].argmax(axis=1)]]
    return np.sqrt(np.nan_to_num(out, nan=np.inf, posinf=np.inf))


def _visits(boxes: Boxes, k: int, penalty: float):
    """For a block: (target, source, point, bound) for every block that may hold a neighbour of a point."""

    def work(rows: pa.Table) -> pa.Table:
        x, c = _numbers(rows), _categories(rows)
        weight = np.array([len(m) for m in rows["members"].to_pylist()])
        bound = _bounds(x, *_codes(rows), weight, k, penalty)
        first, last = boxes.places(c)
        own = np.fmin.reduce(x, keepdims=True), np.fmax.reduce(x, keepdims=True), [v.min(keepdims=True) for v in first], [v.max(keepdims=True) for v in last]
        away = boxes.away(*own, np.arange(len(boxes.number)), penalty)[0]
        ranked, row, at = np.argsort(bound, kind="stable"), [], []
        for start in range(0, len(x), STEP):
            some = ranked[start : start + STEP]
            near = np.flatnonzero(away <= _within(bound[some].max()))
            i, j = np.nonzero(boxes.away(x[some], x[some], [v[some] for v in first], [v[some] for v in last], near, penalty) <= _within(bound[some])[:, None])
            row.append(some[i])
            at.append(near[j])
        of, target = np.concatenate(row), boxes.number[np.concatenate(at)]
        found = rows.select(["block", "node", "x", "c"]).take(pa.array(of))
        return pa.table({"target": pa.array(target, pa.int32()), "source": found["block"], "node": found["node"], "x": found["x"], "c": found["c"], "bound": pa.array(bound[of])})

    return work


def _best(k: int, penalty: float):
    """For a pair of blocks: of the ``k`` + 1 nearest members of the one to each visitor of the other those within its bound."""

    def work(rows: pa.Table) -> pa.Table:
        asks = rows["asks"].to_numpy()
        ours, theirs = (rows.take(pa.array(np.flatnonzero(s))) for s in (asks, ~asks))
        (x, y), (c, d) = (_numbers(ours), _numbers(theirs)), _codes(ours, theirs)
        members = theirs["members"].to_pylist()
        weight = np.array([len(m) for m in members])
        ids, starts = np.array([i for m in members for i in m], dtype=np.int64), np.cumsum(weight) - weight
        nodes, limit, places, far_of, found, owners = ours["node"].to_numpy(), _within(ours["bound"].to_numpy()) ** 2, [], [], [], []
        for start in range(0, len(x), STEP):
            far = distances(x[start : start + STEP], c[start : start + STEP], y, d, penalty)
            most = limit[start : start + STEP]
            if len(y) > k + 1:
                most = np.fmin(most, np.partition(far, k, axis=1)[:, k])
            row, of = np.nonzero(far <= most[:, None])
            far, times = far[row, of], weight[of]
            inside = np.arange(times.sum()) - np.repeat(np.cumsum(times) - times, times)
            row, far, of, member = (np.repeat(v, times) for v in (row, far, of, starts[of]))
            member = member + inside
            order = np.lexsort((ids[member], far, row))
            row = row[order]
            kept = np.arange(len(row)) - np.searchsorted(row, row) <= k
            order = order[kept]
            places.append(nodes[start + row[kept]])
            far_of.append(far[order])
            found.append(ids[member[order]])
            owners.append(of[order])
        of = pa.array(np.concatenate(owners))
        return pa.table({"node": pa.array(np.concatenate(places)), "far": pa.array(np.concatenate(far_of)), "id": pa.array(np.concatenate(found)), "x": theirs["x"].take(of), "c": theirs["c"].take(of)})

    return work


def nearest(points: DataFrame, k: int, *, penalty: float = 1.0, pivots: int = CELLS, block: int = BLOCK) -> DataFrame:
    """(id, x, c, near): for each of the ``points`` (id, x: numbers, c: categories) the ``k`` nearest others, nearest first, ties by
    id, as (far, id, x, c) with the squared distance. Ids are distinct; numbers are finite and categories not null. There are
    ``pivots`` cells at least, and as many as there are blocks of points."""
    kinds = "far double, id long, x array<double>, c array<string>"
    spark = points.sparkSession
    rank = F.row_number().over(Window.partitionBy("x", "c").orderBy("id"))
    ranked = points.select("id", "x", "c").withColumn("n", rank)
    nodes = written(ranked.filter(F.col("n") <= k + 1).groupBy("x", "c").agg(F.array_sort(F.collect_list("id")).alias("members")).select(F.col("members")[0].alias("node"), "members", "x", "c"), "nodes")
    n, numbers, categories = nodes.agg(F.count("*"), F.max(F.size("x")), F.max(F.size("c"))).first()
    if not n:
        drop_table(nodes)
        return points.select("id", "x", "c", F.array().cast(f"array<struct<{kinds.replace('far ', 'far:').replace('id ', 'id:').replace('x ', 'x:').replace('c ', 'c:')}>>").alias("near"))
    cells = max(pivots, -(-n // block))
    share = round(min(1.0, SAMPLE * cells / n) * (1 << 30)) if cells > 1 else 0
    drawn = nodes.filter(F.pmod(F.xxhash64(F.lit("cut"), "node"), F.lit(1 << 30)) < share).select("x", "c").collect() if share else []  # some rows per cell
    tree = _cuts(np.array([r["x"] for r in drawn], dtype=float).reshape(len(drawn), numbers), np.array([r["c"] for r in drawn], dtype=object).reshape(len(drawn), categories), cells, penalty)
    placed = written(nodes.mapInArrow(_assigned(tree), f"node long, members array<long>, {POINT}, cell int"), "cells")
    sizes = sorted((r["cell"], -(-r["n"] // (2 * block))) for r in placed.groupBy("cell").agg(F.count("*").alias("n")).collect())  # a row per cell
    parts = [(cell, pieces, int(first)) for (cell, pieces), first in zip(sizes, np.cumsum([0, *[p for _, p in sizes]]), strict=False)]
    dealt = placed.join(F.broadcast(spark.createDataFrame(parts, "cell int, pieces int, first int")), "cell")
    dealt = dealt.select((F.col("first") + F.pmod(F.xxhash64(F.lit("block"), "node"), F.col("pieces"))).cast("int").alias("block"), "node", "members", "x", "c")
    edges = [f(F.col(v)[j]).alias(f"{v}{side}{j}") for v, m in (("x", numbers), ("c", categories)) for j in range(m) for side, f in (("l", F.min), ("h", F.max))]
    boxes = Boxes(dealt.groupBy("block").agg(F.count("*").alias("n"), *edges).collect(), numbers, categories)  # a row per block
    visits = written(dealt.groupBy("block").applyInArrow(_visits(boxes, k, penalty), f"target int, source int, node long, {POINT}, bound double"), "visits")
    pairs = visits.select("target", "source").distinct()
    theirs = dealt.join(pairs, F.col("block") == F.col("target")).select("target", "source", "node", "members", "x", "c", F.lit(None).cast("double").alias("bound"), F.lit(False).alias("asks"))
    both = visits.select("target", "source", "node", F.array().cast("array<long>").alias("members"), "x", "c", "bound", F.lit(True).alias("asks")).unionByName(theirs)
    found = both.groupBy("target", "source").applyInArrow(_best(k, penalty), f"node long, {kinds}")
    best = found.withColumn("n", F.row_number().over(Window.partitionBy("node").orderBy("far", "id"))).filter(F.col("n") <= k + 1)
    lists = best.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("far", "id", "x", "c"))).alias("all"))
    named = written(nodes.select(F.col("node").alias("__n"), F.col("x").alias("__x"), F.col("c").alias("__c")).join(lists, F.col("__n") == F.col("node")), "near")
    for table in (nodes, placed, visits):
        drop_table(table)
    out = points.select("id", "x", "c").join(named, (F.col("x") == F.col("__x")) & (F.col("c") == F.col("__c")))
    return out.select("id", "x", "c", F.slice(F.filter("all", lambda e: e["id"] != F.col("id")), 1, k).alias("near"))
