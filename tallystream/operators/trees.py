"""Ensembles of binary trees: scores, and exact Shapley contributions of features, on arrays.

A node goes left where the value of its feature is at most its threshold; a missing value (NaN) goes right. The value of a feature
set is the expectation over a tree where splits of features outside the set are averaged by the rows their branches covered in
training. For a leaf that is a product over the features of its path, of o (whether the row follows all splits on the feature)
inside the set and z (the share of rows that do) outside, so the contribution of feature i is the leaf's value times (o_i - z_i)
times a weighted sum of coefficients of the polynomial of (z_j + o_j y) over the other features. There are few patterns of o for a
leaf, and each is worked out once for all rows that have it.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.sources.artifacts import opened, sealed

#: Path features up to which the contributions of all patterns are kept.
PATTERNS = 8


@dataclass(frozen=True)
class Tree:
    """Nodes by number, the root first; ``feature`` is -1 at a leaf; ``cover`` is the weight of training rows."""

    feature: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    value: np.ndarray
    cover: np.ndarray

    @classmethod
    def of(cls, nodes: list[tuple]) -> Tree:
        """From (feature, threshold, left, right, value, cover) of each node."""
        columns = list(zip(*nodes, strict=True))
        return cls(*[np.array(c, dtype=kind) for c, kind in zip(columns, (int, float, int, int, float, float), strict=True)])

    def leaves(self, x: np.ndarray) -> np.ndarray:
        """The leaf of each row."""
        at = np.zeros(len(x), dtype=int)
        rows = np.flatnonzero(self.feature[at] >= 0)
        while len(rows):
            node = at[rows]
            goes_left = x[rows, self.feature[node]] <= self.threshold[node]
            at[rows] = np.where(goes_left, self.left[node], self.right[node])
            rows = rows[self.feature[at[rows]] >= 0]
        return at

    def paths(self) -> Iterator[tuple[int, dict[int, list]]]:
        """Each leaf with its features: [lowest bound that it stays above or None, highest bound or None, share of rows]."""
        stack: list[tuple[int, dict[int, list]]] = [(0, {})]
        while stack:
            node, path = stack.pop()
            f = int(self.feature[node])
            if f < 0:
                yield node, path
                continue
            for child, is_left in ((int(self.left[node]), True), (int(self.right[node]), False)):
                low, high, share = path.get(f, [None, None, 1.0])
                at = float(self.threshold[node])
                if is_left:
                    high = at if high is None else min(high, at)
                else:
                    low = at if low is None else max(low, at)
                stack.append((child, path | {f: [low, high, share * self.cover[child] / self.cover[node]]}))


def _path_contributions(ones: np.ndarray, shares: np.ndarray) -> np.ndarray:
    """Contributions of a leaf of value 1 for patterns ``ones`` (rows, m) and the features' ``shares`` (m)."""
    m = len(shares)
    weights = np.array([math.factorial(k) * math.factorial(m - 1 - k) / math.factorial(m) for k in range(m)])
    out = np.empty(ones.shape)
    for i in range(m):
        poly = np.zeros((len(ones), m))
        poly[:, 0] = 1.0
        for j in range(m):
            if j != i:
                poly[:, 1:], poly[:, 0] = poly[:, 1:] * shares[j] + poly[:, :-1] * ones[:, j, None], poly[:, 0] * shares[j]
        out[:, i] = (ones[:, i] - shares[i]) * (poly @ weights)
    return out


class _Leaf:
    """A leaf prepared for contributions."""

    def __init__(self, value: float, path: dict[int, list]):
        self.features = np.array(list(path), dtype=int)
        self.bounds = [(low, high) for low, high, _ in path.values()]
        self.shares, self.value = np.array([share for *_, share in path.values()]), value
        m = len(self.features)
        every = ((np.arange(1 << m)[:, None] >> np.arange(m)) & 1).astype(float) if m <= PATTERNS else None
        self.table = None if every is None else value * _path_contributions(every, self.shares)

    def add(self, x: np.ndarray, out: np.ndarray) -> None:
        m = len(self.features)
        ones = np.ones((len(x), m), dtype=bool)
        for j, (f, (low, high)) in enumerate(zip(self.features, self.bounds, strict=True)):
            if high is not None:
                ones[:, j] = x[:, f] <= high
            if low is not None:
                ones[:, j] &= ~(x[:, f] <= low)
        if self.table is not None:
            out[:, self.features] += self.table[ones @ (1 << np.arange(m))]
        else:
            patterns, of = np.unique(ones, axis=0, return_inverse=True)
            out[:, self.features] += (self.value * _path_contributions(patterns.astype(float), self.shares))[of.reshape(-1)]


@dataclass(frozen=True)
class Ensemble:
    """A weighted sum of trees plus ``base``, in log-odds, over the features ``names``."""

    names: tuple[str, ...]
    trees: tuple[Tree, ...]
    weights: tuple[float, ...]
    base: float = 0.0

    def first(self, n: int) -> Ensemble:
        return Ensemble(self.names, self.trees[:n], self.weights[:n], self.base)

    def margin(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        for tree, weight in zip(self.trees, self.weights, strict=True):
            out += weight * tree.value[tree.leaves(x)]
        return out

    def probability(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.margin(x), -500, 500)))

    @cached_property
    def _leaves(self) -> list[_Leaf]:
        return [_Leaf(w * float(t.value[leaf]), path) for t, w in zip(self.trees, self.weights, strict=True) for leaf, path in t.paths() if path]

    @cached_property
    def expected(self) -> float:
        """The margin without any feature; contributions add up to the margin minus this."""
        return self.base + sum(w * float(t.value[leaf]) * math.prod(share for *_, share in path.values()) for t, w in zip(self.trees, self.weights, strict=True) for leaf, path in t.paths())

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """Shapley contributions to the margin, (rows, features)."""
        out = np.zeros((len(x), len(self.names)))
        for leaf in self._leaves:
            leaf.add(x, out)
        return out

    def to_dict(self) -> dict:
        trees = [{k: v.tolist() for k, v in vars(t).items()} for t in self.trees]
        return sealed({"type": "trees", "version": 1, "inputs": list(self.names), "trees": trees, "weights": list(self.weights), "base": self.base})

    @classmethod
    def from_dict(cls, document: dict, inputs: list[str] | None = None) -> Ensemble:
        """The ensemble of a document, after its digest was verified; with ``inputs`` it must be made for these columns."""
        d = opened(document, kind="trees", version=1)
        if inputs is not None and list(inputs) != d["inputs"]:
            raise ValueError("the trees were made for other inputs")
        return cls(tuple(d["inputs"]), tuple(Tree(**{k: np.array(v) for k, v in t.items()}) for t in d["trees"]), tuple(d["weights"]), d["base"])


def from_spark(model, names: list[str]) -> Ensemble:
    """A fitted GBTClassificationModel as an ensemble in log-odds, which are twice the model's own margin."""
    trees = []
    for tree in model.trees:
        nodes: list = []
        stack = [(tree._call_java("rootNode"), None, "")]
        while stack:
            node, parent, side = stack.pop()
            number = len(nodes)
            if parent is not None:
                nodes[parent][side] = number
            nodes.append({"feature": -1, "threshold": 0.0, "left": -1, "right": -1, "value": float(node.prediction()), "cover": float(node.impurityStats().count())})
            if node.subtreeDepth() > 0:
                split = node.split()
                if not split.getClass().getSimpleName().startswith("Continuous"):
                    raise ValueError("categorical splits are not supported")
                nodes[number] |= {"feature": int(split.featureIndex()), "threshold": float(split.threshold())}
                stack += [(node.rightChild(), number, "right"), (node.leftChild(), number, "left")]
        trees.append(Tree.of([tuple(n.values()) for n in nodes]))
    return Ensemble(tuple(names), tuple(trees), tuple(2.0 * float(w) for w in model.treeWeights))


DRIVERS = "array<struct<feature:string,contribution:double,direction:string>>"


def largest(names: tuple[str, ...], contributions: np.ndarray, n: int) -> list[list[dict]]:
    """The ``n`` contributions of the largest size of each row, largest first, ties by the order of features."""
    order = np.argsort(-np.abs(contributions), axis=1, kind="stable")[:, :n]
    return [[{"feature": names[j], "contribution": float(row[j]), "direction": "higher_risk" if row[j] > 0 else "lower_risk"} for j in js] for row, js in zip(contributions, order, strict=True)]


def _largest_array(names: tuple[str, ...], contributions: np.ndarray, n: int) -> pa.Array:
    """``largest`` as an Arrow array, for whole batches at once."""
    order = np.argsort(-np.abs(contributions), axis=1, kind="stable")[:, :n]
    values = np.take_along_axis(contributions, order, axis=1)
    sides = pa.array(["lower_risk", "higher_risk"]).take(pa.array((values > 0).reshape(-1).astype(np.int32)))
    parts = pa.StructArray.from_arrays([pa.array(names, pa.string()).take(pa.array(order.reshape(-1))), pa.array(values.reshape(-1), pa.float64()), sides], ["feature", "contribution", "direction"])
    return pa.ListArray.from_arrays(pa.array(np.arange(len(order) + 1, dtype=np.int32) * np.int32(order.shape[1])), parts)


def _matrix(column: pa.Array, n: int) -> np.ndarray:
    """An array column of ``n`` numbers a row as (rows, n)."""
    if column.null_count or not (column.value_lengths().to_numpy(zero_copy_only=False) == n).all():
        raise ValueError(f"vectors have {n} numbers")
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, n)


def score_rows(df: DataFrame, model: Ensemble, vector: str = "vector", *, name: str = "p", drivers: int = 0) -> DataFrame:
    """Add the probability from the array column ``vector``; with ``drivers``, also that many of the largest contributions and
    ``expected``, the margin without features. Runs in Arrow batches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(batch.schema.get_field_index(vector)), len(model.names))
            columns = dict(zip(batch.schema.names, batch.columns, strict=True)) | {name: pa.array(model.probability(x), pa.float64())}
            if drivers:
                columns |= {"drivers": _largest_array(model.names, model.contributions(x), drivers), "expected": pa.array(np.full(len(x), model.expected), pa.float64())}
            yield pa.RecordBatch.from_arrays(list(columns.values()), list(columns))

    out = df.withColumn(name, F.lit(0.0))
    if drivers:
        out = out.withColumns({"drivers": F.lit(None).cast(DRIVERS), "expected": F.lit(0.0)})
    return df.mapInArrow(run, out.schema)
