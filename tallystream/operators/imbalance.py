"""Class weights, deterministic under-sampling and synthetic minority rows, for training rows only."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.operators.checks import duplicate_keys, enforce
from tallystream.operators.nearest import nearest
from tallystream.operators.preprocess import Preprocessor, bound_context
from tallystream.operators.profile import bottom_k, sample_order
from tallystream.operators.split import SplitConfig
from tallystream.sources.shared import written

#: The strategies.
STRATEGIES = ("none", "class_weight", "random_under", "smotenc")
#: Synthetic rows that a task gives at once, about.
BATCH = 10_000


@dataclass(frozen=True)
class ImbalanceConfig:
    strategy: str = "class_weight"
    ratio: float = 0.5
    neighbors: int = 5
    seed: int = 42

    def __post_init__(self):
        if self.strategy not in STRATEGIES:
            raise ValueError(f"unknown strategy {self.strategy}")
        if not 0 < self.ratio <= 1 or self.neighbors < 1:
            raise ValueError("the ratio must lie in (0, 1], and there must be a neighbour")


def counts(df: DataFrame, label: str) -> tuple[int, int]:
    """(negatives, positives); both classes must occur."""
    bad, good = df.agg(F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)).first()
    if not bad or not good:
        raise ValueError("both classes must occur")
    return good, bad


def class_weights(negatives: int, positives: int) -> tuple[float, float]:
    n = negatives + positives
    return n / (2 * negatives), n / (2 * positives)


def weight(label: Column, weights: tuple[float, float]) -> Column:
    return F.when(label == 1, weights[1]).otherwise(weights[0])


def projected(negatives: int, positives: int, config: ImbalanceConfig) -> tuple[int, int]:
    """(negatives, positives) after the strategy. The ratio of positives to negatives must rise."""
    if config.strategy in ("none", "class_weight"):
        return negatives, positives
    if config.ratio <= positives / negatives:
        raise ValueError("the ratio must exceed the current one")
    if config.strategy == "random_under":
        return math.floor(positives / config.ratio), positives
    return negatives, math.floor(negatives * config.ratio)


def report(negatives: int, positives: int, config: ImbalanceConfig) -> list[dict]:
    out = []
    for strategy in STRATEGIES:
        n, p = projected(negatives, positives, ImbalanceConfig(strategy, config.ratio, config.neighbors, config.seed))
        w = class_weights(negatives, positives) if strategy == "class_weight" else (1.0, 1.0)
        out.append({"strategy": strategy, "negatives": n, "positives": p, "negative_weight": w[0], "positive_weight": w[1]})
    return out


def random_under(df: DataFrame, label: str, key: str, config: ImbalanceConfig) -> DataFrame:
    """All positives and the negatives of the smallest hash of the key."""
    negatives, _ = projected(*counts(df, label), config)
    return df.filter(F.col(label) == 1).unionByName(bottom_k(df.filter(F.col(label) == 0), key, negatives, config.seed))


def negative_sample(df: DataFrame, label: str, key: str, per_positive: float, seed: int = 42) -> DataFrame:
    """All positives and at most ``per_positive`` negatives for each, in an order of their own."""
    negatives, positives = counts(df, label)
    kept = bottom_k(df.filter(F.col(label) == 0), key, min(negatives, int(per_positive * positives)), seed)
    return df.filter(F.col(label) == 1).unionByName(kept).orderBy(sample_order(F.col(key), seed + 1), key)


def smotenc(df: DataFrame, label: str, key: str, numeric: list[str], nominal: list[str], config: ImbalanceConfig) -> DataFrame:
    """Add synthetic positives: between a positive and one of its nearest ones in the numbers, with the neighbours' most
    frequent categories. Synthetic rows have null in all other columns.

    Positives are numbered in the order of their keys, and their neighbours are found exactly (``nearest``), in all tasks. Synthetic
    row i starts from positive i modulo their number, with random numbers of its own. No task holds more than blocks of positives and
    a batch of synthetic rows, so there is no bound on the rows.
    """
    negatives, positives = counts(df, label)
    _, wanted = projected(negatives, positives, config)
    if positives <= config.neighbors:
        raise ValueError("there must be more positives than neighbours")
    minority = df.filter(F.col(label) == 1)
    points = numbered(minority.select(key, F.array(*[F.col(f"`{c}`").cast("double") for c in numeric]).cast("array<double>").alias("x"), F.array(*[F.col(f"`{c}`").cast("string") for c in nominal]).cast("array<string>").alias("c")), key)
    spreads = minority.agg(*[F.stddev_pop(F.col(f"`{c}`").cast("double")) for c in numeric]).first() if numeric else []
    found = nearest(points, config.neighbors, penalty=float(np.median(list(spreads))) if numeric else 1.0)
    extra, seed = wanted - positives, config.seed
    columns = [*numeric, *nominal]

    def make(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            ids, near = batch["id"].to_numpy(), batch["near"]
            others, starts, many = near.flatten(), near.offsets.to_numpy()[:-1] - near.offsets[0].as_py(), near.value_lengths().to_numpy()
            x, y = (v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1) for v in (batch["x"], others.field("x")))
            votes = _votes(others.field("c"), starts, many, len(nominal))
            times = -((ids - extra) // positives)
            base = np.repeat(np.arange(len(ids)), times)
            row = ids[base] + positives * (np.arange(len(base)) - np.repeat(np.cumsum(times) - times, times))
            for start in range(0, len(base), BATCH):
                of, chosen, step = base[start : start + BATCH], [], []
                for i, n in zip(row[start : start + BATCH].tolist(), many[of].tolist(), strict=True):
                    draw = np.random.default_rng([seed, i])
                    chosen.append(draw.integers(n))
                    step.append(draw.random())
                made = x[of] + np.array(step)[:, None] * (y[starts[of] + np.array(chosen)] - x[of])
                yield pa.RecordBatch.from_arrays([*[pa.array(made[:, j]) for j in range(len(numeric))], *[v.take(pa.array(of)) for v in votes]], names=columns)

    kinds = dict(df.dtypes)
    schema = ", ".join([f"`{n}` double" for n in numeric] + [f"`{n}` string" for n in nominal])
    made = found.filter(F.col("id") < extra).select("id", "x", "near").mapInArrow(make, schema).withColumn(label, F.lit(1))
    made = made.select(*[F.col(n).cast(kinds[n]).alias(n) if n in [*columns, label] else F.lit(None).cast(kinds[n]).alias(n) for n in df.columns])
    return df.unionByName(made)


def _votes(lists: pa.ListArray, starts: np.ndarray, many: np.ndarray, columns: int) -> list[pa.Array]:
    """For each column of categories the most frequent of each point's neighbours, of several the first. ``lists`` has the
    categories of all neighbours, those of a point from its place of ``starts`` on."""
    flat, out = lists.flatten(), []
    for j in range(columns):
        coded = flat.take(pa.array(np.arange(j, len(flat), columns))).dictionary_encode()
        levels = coded.dictionary.to_pylist()
        ranked = sorted(range(len(levels)), key=lambda i: levels[i])
        rank = np.argsort(ranked)[coded.indices.to_numpy()]
        at = starts[:, None] + np.arange(many.max())
        there = np.arange(many.max()) < many[:, None]
        seen = np.where(there, rank[np.minimum(at, len(rank) - 1)], -1)
        times = (seen[:, :, None] == seen[:, None, :]).sum(axis=2)
        best = np.where(there, times * (len(levels) + 1) - seen, -1).argmax(axis=1)
        out.append(pa.array(levels, pa.string()).take(pa.array(np.array(ranked)[seen[np.arange(len(seen)), best]])))
    return out


def numbered(rows: DataFrame, key: str) -> DataFrame:
    """(id, and the other columns): rows numbered from 0 in the order of their keys, as a written table. The driver gets a count per
    partition."""
    parts = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    placed = written(rows.repartitionByRange(parts, key).sortWithinPartitions(key).withColumn("__at", F.monotonically_increasing_id()), "numbered")
    part, inside = F.shiftright("__at", 33).cast("int"), F.col("__at").bitwiseAND(F.lit((1 << 33) - 1))
    sizes = {r["p"]: r["n"] for r in placed.groupBy(part.alias("p")).agg(F.count("*").alias("n")).collect()}
    starts = np.concatenate([[0], np.cumsum([sizes.get(i, 0) for i in range(max(sizes, default=0))])]).astype(int).tolist()
    return placed.select((F.element_at(F.lit(starts), part + 1) + inside).cast("long").alias("id"), *[c for c in rows.columns if c != key])


def training_batch(
    df: DataFrame, label: str, key: str, numeric: list[str], nominal: list[str], config: ImbalanceConfig, *, partition: str = "train", fitted: Preprocessor | None = None, by: SplitConfig | None = None
) -> tuple[DataFrame, dict]:
    """The rows to train on with a column ``weight``, and a record of the counts before and after.

    Labels must be 0 or 1 and keys unique. With the state that was ``fitted`` on these rows (and ``by``, their columns) rows,
    times, labels and keys must be those it was fitted on. The counts afterwards must be the projected ones.
    """
    if partition != "train":
        raise ValueError("only training rows are resampled")
    enforce(df, {label: F.col(label).isin(0, 1)})
    if duplicate_keys(df, key).limit(1).count():
        raise ValueError("keys repeat")
    record: dict = {"strategy": config.strategy, "config": dict(vars(config))}
    if fitted is not None:
        context = bound_context(df, by or SplitConfig())
        if wrong := [k for k, v in context.items() if fitted.context.get(k) != v]:
            raise ValueError(f"the rows are not those of the fit: {', '.join(wrong)}")
        record |= {"preprocessor_sha256": fitted.to_dict()["sha256"], "schema_sha256": fitted.schema_digest(), "split_sha256": fitted.context.get("split_sha256"), "input_key_sha256": context["key_sha256"]}
    negatives, positives = counts(df, label)
    out = df
    if config.strategy == "random_under":
        out = written(random_under(df, label, key, config), "training-rows")
    elif config.strategy == "smotenc":
        out = written(smotenc(df, label, key, numeric, nominal, config), "training-rows")
    weights = class_weights(negatives, positives) if config.strategy == "class_weight" else (1.0, 1.0)
    after = projected(negatives, positives, config)
    if out is not df and counts(out, label) != after:
        raise RuntimeError("the rows after sampling are not as many as projected")
    return out.withColumn("weight", weight(F.col(label), weights)), record | {"before": [negatives, positives], "after": list(after), "weights": list(weights)}
