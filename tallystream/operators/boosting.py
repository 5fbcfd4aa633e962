"""Boosted trees on histograms, stopped by the average precision of validation rows.

Bin edges are found once; rows are kept as one byte a feature. Rows of one label that are alike in all bytes have one margin, so
one pass for every few rounds counts how many rows of each such group every round draws, and trees are grown on the groups. A level
of a tree is one pass over these: each task adds up gradients and second derivatives by (node, feature, bin), times the rows drawn,
and a row per such cell and task is shuffled. Both are rounded to whole multiples of 2^-24 first, so sums do not depend on their
order and a fit can be repeated exactly. The driver holds cells, whose number is bounded by depth, features and bins, and the trees.
Margins are written out every few rounds; between, the trees since are applied while groups are read.

The average precision of validation rows is exact after every round; it is worked out for a few rounds at a time.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallystream.operators import metrics
from tallystream.operators.histograms import bins_at, bins_of, bytes_array, edges_of, grouped
from tallystream.operators.trees import Ensemble, Tree
from tallystream.sources.shared import drop_table, written

#: Multiples of a gradient that sums are made of.
UNIT = float(1 << 24)
#: Rounds at most whose draws are counted in one pass over the rows.
ROUNDS = 20
CELLS = "node int, feature int, bin int, g long, h long"


@dataclass(frozen=True)
class BoostConfig:
    """The defaults of the boosted component."""

    rounds: int = 800
    rate: float = 0.06
    depth: int = 6
    child_weight: float = 5.0
    rows: float = 0.85
    columns: float = 0.85
    l1: float = 0.0
    l2: float = 1.0
    positive_weight: float = 1.0
    patience: int = 40
    bins: int = 64
    together: int = 5
    seed: int = 42

    def __post_init__(self):
        if not 2 <= self.bins <= 256 or self.rounds < 1 or self.depth < 1 or self.patience < 1 or self.together < 1:
            raise ValueError("bins are one byte, and there is at least one round, level and round of patience")
        if not (0 < self.rows <= 1 and 0 < self.columns <= 1 and self.rate > 0):
            raise ValueError("shares lie in (0, 1], and the rate is positive")


@dataclass
class Boosted:
    """The trees up to the best round, and the average precision after each round that was tried."""

    model: Ensemble
    best_round: int
    history: list[float] = field(default_factory=list)


def bin_edges(df: DataFrame, features: list[str], bins: int) -> list[list[float]]:
    """Per feature at most ``bins`` - 1 rising values that rows are cut at; a row belongs to the first that it is not above."""
    return edges_of(df, {c: F.col(f"`{c}`") for c in features}, bins)


def _binned(df: DataFrame, features: list[str], label: str, key: str, edges: list[list[float]]) -> DataFrame:
    """(y, draw, bins): a hash of the key in [0, 1) and a byte per feature; a missing value is above all edges."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), bytes_array(bins_at(batch.columns[2:], edges))], ["y", "draw", "bins"])

    rows = df.select(F.col(label).cast("int").alias("y"), F.xxhash64(F.col(key).cast("string")).alias("draw"), *[F.col(f"`{c}`").cast("double").alias(f"f{i}") for i, c in enumerate(features)])
    return rows.mapInArrow(run, "y int, draw long, bins binary")


def _column(batch: pa.RecordBatch, name: str) -> np.ndarray:
    return batch.column(batch.schema.get_field_index(name)).to_numpy(zero_copy_only=False)


class _Growing:
    """A tree while it grows: splits are between bins, and every level's open nodes are its leaves so far."""

    def __init__(self):
        self.nodes = [[-1, 0, -1, -1, 0.0, 0.0]]  # feature, bin, left, right, value, cover

    def tree(self) -> Tree:
        return Tree.of([tuple(n) for n in self.nodes])

    def split(self, node: int, feature: int, at: int) -> tuple[int, int]:
        left = len(self.nodes)
        self.nodes += [[-1, 0, -1, -1, 0.0, 0.0], [-1, 0, -1, -1, 0.0, 0.0]]
        self.nodes[node][:4] = [feature, at, left, left + 1]
        return left, left + 1


def _sampled(draw: np.ndarray, seed: int, round_: int, share: float) -> np.ndarray:
    """Whether a row belongs to the round's sample: by its key alone."""
    if share >= 1:
        return np.ones(len(draw), dtype=bool)
    x = draw.view(np.uint64) ^ np.uint64((seed * 1_000_003 + round_ + 1) * 0x9E3779B97F4A7C15 % (1 << 64))
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(float) / float(1 << 53) < share


def _groups(rows: DataFrame, n: int, config: BoostConfig, rounds: range, known: DataFrame | None) -> DataFrame:
    """(y, bins, d0, d1, ..., margin): the groups of all rows, and how many of their rows are drawn in each of the rounds. Margins are
    those of ``known`` groups, or 0."""

    def read(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        draw = _column(batch, "draw")
        return _column(batch, "y"), bins_of(batch, n), np.stack([_sampled(draw, config.seed, r, config.rows) for r in rounds]).astype(np.int64)

    names = [f"d{i}" for i in range(len(rounds))]
    found = grouped(rows, read, names)
    if known is None:
        return found.withColumn("margin", F.lit(0.0))
    both = found.withColumn("margin", F.lit(None).cast("double")).unionByName(known.select("y", "bins", "margin", *[F.lit(0).cast("long").alias(c) for c in names]))
    return both.groupBy("y", "bins").agg(*[F.sum(c).alias(c) for c in names], F.max("margin").alias("margin"))


def _cells(trees: list[Tree], growing: Tree, opened: list[int], used: np.ndarray, n: int, config: BoostConfig, drawn: str):
    """For mapInArrow: sums by (node, feature, bin) of the rows in the open nodes, each group as often as ``drawn`` says."""
    width = config.bins

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        place = np.full(len(growing.feature), -1)
        place[opened] = np.arange(len(opened))
        sums = np.zeros((2, len(opened), len(used), width), dtype=np.int64)
        for batch in batches:
            bins = bins_of(batch, n)
            y, margin = _column(batch, "y"), _column(batch, "margin").copy()
            for tree in trees:
                margin += config.rate * tree.value[tree.leaves(bins)]
            node = place[growing.leaves(bins)]
            times = _column(batch, drawn)
            rows = np.flatnonzero((node >= 0) & (times > 0))
            if not len(rows):
                continue
            p, weight = 1 / (1 + np.exp(-margin[rows])), np.where(y[rows] == 1, config.positive_weight, 1.0)
            both = np.rint(np.stack([weight * (p - y[rows]), weight * p * (1 - p)]) * UNIT).astype(np.int64) * times[rows]
            for i, f in enumerate(used):
                cell = node[rows] * width + bins[rows, f]
                by = np.argsort(cell, kind="stable")
                cuts = np.flatnonzero(np.diff(cell[by], prepend=-1))
                at = cell[by][cuts]
                sums[:, at // width, i, at % width] += np.add.reduceat(both[:, by], cuts, axis=1)
        a, i, b = np.nonzero(sums[1] | sums[0])
        if len(a):
            columns = [*[pa.array(c, pa.int32()) for c in (a, used[i], b)], *[pa.array(sums[k][a, i, b], pa.int64()) for k in range(2)]]
            yield pa.RecordBatch.from_arrays(columns, ["node", "feature", "bin", "g", "h"])

    return run


def _leaf(g: float, h: float, config: BoostConfig) -> float:
    return -np.sign(g) * max(abs(g) - config.l1, 0.0) / (h + config.l2)


def _best(g: np.ndarray, h: np.ndarray, total: tuple[float, float], config: BoostConfig) -> tuple[float, int, int]:
    """(gain, place of the feature, bin) of the best split from sums by (feature, bin); the first one on ties."""
    score = lambda a, b: np.maximum(np.abs(a) - config.l1, 0.0) ** 2 / (b + config.l2)
    gl, hl = np.cumsum(g, axis=1)[:, :-1], np.cumsum(h, axis=1)[:, :-1]
    gr, hr = total[0] - gl, total[1] - hl
    gain = score(gl, hl) + score(gr, hr) - score(total[0], total[1])
    gain = np.where((hl >= config.child_weight) & (hr >= config.child_weight), gain, -np.inf)
    at = int(gain.argmax())
    return float(gain.reshape(-1)[at]), at // gain.shape[1], at % gain.shape[1]


def _grow(table: DataFrame, trees: list[Tree], n: int, config: BoostConfig, round_: int, drawn: str) -> Tree:
    """One tree, level by level, on the rows that the column ``drawn`` counts."""
    draw = np.random.default_rng([config.seed, round_])
    used = np.sort(draw.permutation(n)[: max(1, round(config.columns * n))])
    spot = {int(f): i for i, f in enumerate(used)}
    growing, opened, totals = _Growing(), [0], {}
    for level in range(config.depth):
        cells = table.select("y", "bins", "margin", drawn).mapInArrow(_cells(trees, growing.tree(), opened, used, n, config, drawn), CELLS)
        found = cells.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect()  # a row per cell
        sums = np.zeros((2, len(opened), len(used), config.bins))
        for r in found:
            sums[:, r["node"], spot[r["feature"]], r["bin"]] = r["g"] / UNIT, r["h"] / UNIT
        if level == 0:
            totals[0] = sums[:, 0, 0].sum(axis=1)  # every row has one bin of a feature
        further = []
        for i, node in enumerate(opened):
            gain, f, at = _best(sums[0, i], sums[1, i], tuple(totals[node]), config)
            if gain > 1e-9:
                left, right = growing.split(node, int(used[f]), at)
                totals[left] = sums[:, i, f, : at + 1].sum(axis=1)
                totals[right] = totals[node] - totals[left]
                further += [left, right]
        opened = further
        if not opened:
            break
    for node, (g, h) in totals.items():
        growing.nodes[node][4:] = [_leaf(g, h, config), h]
    return growing.tree()


def _applied(table: DataFrame, trees: list[Tree], n: int, rate: float) -> DataFrame:
    """The table with its margins after these trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, margin = bins_of(batch, n), _column(batch, "margin").copy()
            for tree in trees:
                margin += rate * tree.value[tree.leaves(bins)]
            yield batch.set_column(batch.schema.get_field_index("margin"), "margin", pa.array(margin, pa.float64()))

    return table.mapInArrow(run, table.schema)


def _by_round(table: DataFrame, trees: list[Tree], n: int, rate: float, first: int) -> DataFrame:
    """(round, y, n, p) of every group after each of these trees."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            bins, margin = bins_of(batch, n), _column(batch, "margin").copy()
            for i, tree in enumerate(trees):
                margin += rate * tree.value[tree.leaves(bins)]
                p = 1 / (1 + np.exp(-margin))
                own = [batch.column(batch.schema.get_field_index(c)) for c in ("y", "n")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(p), first + i), pa.int32()), *own, pa.array(p, pa.float64())], ["round", "y", "n", "p"])

    return table.mapInArrow(run, "round int, y int, n long, p double")


def fit_boosted(train: DataFrame, validation: DataFrame, features: list[str], *, label: str = "label", key: str = "key", config: BoostConfig = BoostConfig()) -> Boosted:
    """Boost until the average precision of the validation rows has not risen for ``patience`` rounds, and keep the trees up to the
    best one (the first on ties).

    Labels are 0 or 1 and both occur in both tables. Missing numbers (null or NaN) go to the right at every split. Rows and
    features of a round are drawn by the key and the seed, so the same rows give the same trees, however they are partitioned
    (but for edges of features of very many distinct values, which are approximate).
    """
    n = len(features)
    edges = bin_edges(train, features, config.bins)
    rows = written(_binned(train, features, label, key, edges), "binned")
    whole = lambda batch: (_column(batch, "y"), bins_of(batch, n), np.ones((1, batch.num_rows), dtype=np.int64))
    counted = range(min(config.rounds, config.together * max(1, ROUNDS // config.together)))
    tables = [written(_groups(rows, n, config, counted, None), "groups")]
    tables.append(written(grouped(_binned(validation, features, label, key, edges), whole, ["n"]).withColumn("margin", F.lit(0.0)), "groups"))
    for table in tables:
        good, bad = table.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first()
        if not good or not bad:
            raise ValueError("both classes must occur")
    trees: list[Tree] = []
    fresh: list[Tree] = []
    history: list[float] = []
    best, at = -1.0, 0
    while len(trees) < config.rounds and len(trees) - at < config.patience:
        for _ in range(min(config.together, config.rounds - len(trees))):
            tree = _grow(tables[0], fresh, n, config, len(trees), f"d{counted.index(len(trees))}")
            trees.append(tree)
            fresh.append(tree)
        found = metrics.average_precision(_by_round(tables[1], fresh, n, config.rate, len(trees) - len(fresh) + 1), "y", "p", ["round"], count="n").collect()  # a row per round
        for _, value in sorted((r["round"], r["average_precision"]) for r in found):
            if len(history) - at >= config.patience:  # rounds beyond the stop were grown, but do not count
                break
            history.append(value)
            if value > best:
                best, at = value, len(history)
        if len(trees) >= config.rounds or len(trees) - at >= config.patience:
            break
        applied = [_applied(table, fresh, n, config.rate) for table in tables]
        if len(trees) not in counted:
            counted = range(len(trees), min(config.rounds, len(trees) + len(counted)))
            applied[0] = _groups(rows, n, config, counted, applied[0])
        old, tables = tables, [written(table, "groups") for table in applied]
        for table in old:
            drop_table(table)
        fresh = []
    for table in [rows, *tables]:
        drop_table(table)
    return Boosted(Ensemble(tuple(features), tuple(_unbinned(t, edges) for t in trees[:at]), (config.rate,) * at), at, history)


def _unbinned(tree: Tree, edges: list[list[float]]) -> Tree:
    """Splits at values in place of bins."""
    at = [edges[f][int(b)] if f >= 0 and int(b) < len(edges[f]) else float("inf") if f >= 0 else 0.0 for f, b in zip(tree.feature, tree.threshold, strict=True)]
    return Tree(tree.feature, np.array(at), tree.left, tree.right, tree.value, tree.cover)
