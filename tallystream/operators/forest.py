"""Forests whose trees each balance the classes of their own sample of rows.

Rows are kept as one byte a feature: the place among all values of a feature that has few, or among its quantiles. Draws are added up
for the groups of rows that are alike in all bytes and the label, and Spark's trees are fitted on the groups, weighted by them.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.classification import RandomForestClassifier
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.operators.histograms import bins_at, edges_of, few_values, grouped
from tallystream.operators.trees import Tree
from tallystream.sources.artifacts import opened, sealed
from tallystream.sources.shared import drop_table, written

#: Times at most that a row is drawn for a tree; more has a chance under one in a billion.
MOST = 12
#: Bins of a feature, as Spark's trees have them; trees whose draws are added up in one pass.
BINS, TOGETHER = 32, 10


def _hashed(key: Column, tree: int, seed: int) -> Column:
    """53 bits of a row and a tree."""
    return F.shiftrightunsigned(F.xxhash64(F.lit(seed), F.lit(tree), key), 11)


def _chances() -> np.ndarray:
    """The chance to be drawn no more than 0, 1, ... times."""
    return np.cumsum([math.exp(-1) / math.factorial(k) for k in range(MOST)])


def drawn(key: Column, tree: int, seed: int) -> Column:
    """How often a row is drawn for a tree: a Poisson number of mean 1, by a hash of its key. Rows drawn so in all tasks make a
    sample with replacement, without counting them first."""
    u, chances = _hashed(key, tree, seed) / float(1 << 53), _chances()
    return sum([(u >= float(c)).cast("int") for c in chances[1:]], (u >= float(chances[0])).cast("int"))


@dataclass(frozen=True)
class Forest:
    """Trees with the share of positives at each leaf; the score is their mean."""

    trees: tuple[Tree, ...]
    inputs: int

    def probability(self, x: np.ndarray) -> np.ndarray:
        return np.mean([t.value[t.leaves(x)] for t in self.trees], axis=0)

    def score(self, df: DataFrame, name: str = "p", features: str = "features") -> DataFrame:
        """Add the score from the vector column ``features``."""

        @F.pandas_udf("double")
        def scored(x: pd.Series) -> pd.Series:
            return pd.Series(self.probability(np.stack(x)) if len(x) else [], dtype=float)

        return df.withColumn(name, scored(vector_to_array(F.col(features))))

    def to_dict(self) -> dict:
        return sealed({"type": "forest", "version": 1, "inputs": self.inputs, "trees": [{k: v.tolist() for k, v in vars(t).items()} for t in self.trees]})

    @classmethod
    def from_dict(cls, document: dict) -> Forest:
        d = opened(document, kind="forest", version=1)
        return cls(tuple(Tree(**{k: np.array(v) for k, v in t.items()}) for t in d["trees"]), d["inputs"])


def _tree(model, edges: list[list[float]]) -> Tree:
    """The one tree of a classifier that was fitted on bins, with splits at values and the weighted share of positives as the value of
    a node."""
    nodes: list[list] = []
    stack = [(model.trees[0]._call_java("rootNode"), None, 0)]
    while stack:
        node, parent, side = stack.pop()
        number = len(nodes)
        if parent is not None:
            nodes[parent][side] = number
        stats = list(node.impurityStats().stats())
        nodes.append([-1, 0.0, -1, -1, float(stats[1]) / float(sum(stats)) if len(stats) > 1 else 0.0, float(sum(stats))])
        if node.subtreeDepth() > 0:
            split = node.split()
            f, last = int(split.featureIndex()), math.floor(split.threshold())  # the last bin on the left
            nodes[number][:2] = [f, edges[f][last]]
            stack += [(node.rightChild(), number, 3), (node.leftChild(), number, 2)]
    return Tree.of([tuple(n) for n in nodes])


def sample_weights(rows: DataFrame, label: str, key: str, trees: int, seed: int) -> list[tuple[float, float]]:
    """For each tree the weights of its negatives and positives that balance its own sample, from one pass."""
    cells = [F.sum(F.when(F.col(label) == v, drawn(F.col(key), t, seed)).otherwise(0)).alias(f"n{t}_{v}") for t in range(trees) for v in (0, 1)]
    found = rows.agg(*cells).first()
    out = []
    for t in range(trees):
        negatives, positives = found[f"n{t}_0"] or 0, found[f"n{t}_1"] or 0
        total = negatives + positives
        out.append((total / (2 * negatives) if negatives else 0.0, total / (2 * positives) if positives else 0.0))
    return out


def fit_forest(train: DataFrame, *, trees: int, depth: int, leaf: int, features: str = "features", label: str = "label", key: str | None = None, subset: str = "auto", seed: int = 42) -> Forest:
    """Fit ``trees`` trees on (features, label), each on its own sample of the rows with classes weighted by that sample.

    With a unique ``key`` the samples follow from the keys; without one, rows are numbered as they are read. ``subset`` says how
    many features a split looks at, as in Spark.
    """
    number = F.col(key).cast("string") if key else F.monotonically_increasing_id().cast("string")
    size = len(train.select(vector_to_array(features)).first()[0])
    vector = vector_to_array(F.col(features))
    rows = written(train.select(number.alias("__key"), F.col(label).cast("int").alias("label"), *[vector[i].alias(f"f{i}") for i in range(size)]), "forest-rows")
    columns = {f"f{i}": F.col(f"f{i}") for i in range(size)}
    few, edges = few_values(rows, columns, BINS), edges_of(rows, columns, BINS)
    edges = [[(a + b) / 2 for a, b in zip(few[i], few[i][1:])] if i in few else e for i, e in enumerate(edges)]  # noqa: B905
    found: list[Tree] = []
    for first in range(0, trees, TOGETHER):
        numbers = range(first, min(trees, first + TOGETHER))
        groups = written(_groups(rows, edges, numbers, seed), "forest-groups")
        found += _fitted(groups, edges, numbers, depth, leaf, subset if trees > 1 or subset != "auto" else "all", seed)
        drop_table(groups)
    drop_table(rows)
    return Forest(tuple(found), size)


def _groups(rows: DataFrame, edges: list[list[float]], numbers: range, seed: int) -> DataFrame:
    """(y, bins, n<t>, m<t>): for each of these trees how many draws a group has, and how many of its rows are drawn."""
    size, chances = len(edges), _chances()

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        draws = np.stack([np.searchsorted(chances, c.to_numpy() / float(1 << 53), side="right") for c in batch.columns[1 + size :]])
        return batch.column(0).to_numpy(zero_copy_only=False), bins_at(batch.columns[1 : 1 + size], edges), np.concatenate([draws, draws > 0]).astype(np.int64)

    hashes = [_hashed(F.col("__key"), t, seed).alias(f"h{t}") for t in numbers]
    return grouped(rows.select("label", *[f"f{i}" for i in range(size)], *hashes), read, [f"n{t}" for t in numbers] + [f"m{t}" for t in numbers])


def _fitted(groups: DataFrame, edges: list[list[float]], numbers: range, depth: int, leaf: int, subset: str, seed: int) -> list[Tree]:
    """One tree for each number. A group stands for as many instances as it has drawn rows, up to ``leaf``, so that a leaf has ``leaf``
    rows where it has as many instances."""
    sums = groups.groupBy("y").agg(F.count("*").alias("groups"), *[F.sum(f"n{t}").alias(f"n{t}") for t in numbers]).collect()  # a row per label
    bits = [F.conv(F.hex(F.substring("bins", i + 1, 1)), 16, 10).cast("double") for i in range(len(edges))]
    rows = groups.select(F.col("y").cast("double").alias("label"), array_to_vector(F.array(*bits)).alias("features"), *[c for c in groups.columns if c not in ("y", "bins")])
    # Spark looks for splits in a sample of the square of maxBins instances: with this many that is all of them.
    bins = min(46_340, max(BINS, math.isqrt(sum(r["groups"] for r in sums) * leaf) + 1))
    out = []
    for t in numbers:
        held = {r["y"]: r[f"n{t}"] for r in sums}
        weight = {y: F.lit(sum(held.values()) / (2 * n) if n else 0.0) for y, n in held.items()}
        copies = F.least(F.col(f"m{t}"), F.lit(leaf))
        balanced = F.col(f"n{t}") * F.when(F.col("label") == 1, weight.get(1, F.lit(0.0))).otherwise(weight.get(0, F.lit(0.0)))
        own = rows.filter(F.col(f"n{t}") > 0).select("label", "features", (balanced / copies).alias("weight"), F.explode(F.sequence(F.lit(1).cast("long"), copies.cast("long"))).alias("copy")).drop("copy")
        one = RandomForestClassifier(featuresCol="features", labelCol="label", weightCol="weight", numTrees=1, bootstrap=False, subsamplingRate=1.0, maxDepth=depth, maxBins=bins, minInstancesPerNode=leaf, featureSubsetStrategy=subset, seed=seed + t)
        out.append(_tree(one.fit(own), edges))
    return out
