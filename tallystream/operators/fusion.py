"""Blending of model scores, and the result tables of scored batches."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice, product

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallystream.functions.scalars import clip, logit, mask_tail, sigmoid
from tallystream.operators.metrics import average_precision, best_threshold, check_probabilities, evaluate
from tallystream.sources.artifacts import opened, sealed
from tallystream.sources.tables import write_csv

SPACES = ("probability", "logit")


def normalized(weights: dict[str, float]) -> dict[str, float]:
    total = sum(weights.values())
    if not weights or min(weights.values()) < 0 or total <= 0:
        raise ValueError("weights must not be negative, and one must be positive")
    return {k: v / total for k, v in weights.items()}


def blend(weights: dict[str, float], space: str = "probability") -> Column:
    """Weighted mean of the score columns, in probability or log-odds."""
    if space not in SPACES:
        raise ValueError(f"unknown space {space}")
    parts = [w * (F.col(c) if space == "probability" else logit(F.col(c))) for c, w in normalized(weights).items()]
    mean = sum(parts[1:], parts[0])
    return clip(mean, 0.0, 1.0) if space == "probability" else sigmoid(mean)


#: Blends of three components (boosted, feed-forward, recurrent) that are always tried, and the Dirichlet
#: distribution of the others.
ANCHORS = [(1 / 3, 1 / 3, 1 / 3), (0.70, 0.05, 0.25), (0.65, 0.10, 0.25), (0.60, 0.05, 0.35), (0.55, 0.10, 0.35), (0.50, 0.05, 0.45)]
CONCENTRATION = (4.0, 1.25, 2.5)


def floored(point: Sequence[float], least: float) -> list[float]:
    """A point of the simplex moved into the smaller one whose weights are at least ``least``."""
    return [least + (1 - least * len(point)) * w / sum(point) for w in point]


def blend_points(k: int, seed: int, anchors: Sequence[Sequence[float]] | None = None, concentration: Sequence[float] | None = None) -> Iterator[Sequence[float]]:
    """Points of the simplex of ``k`` weights without end: anchors, then draws of a Dirichlet distribution.

    Three weights have the fixed anchors and distribution unless others are given; other numbers have the equal blend and one for
    each weight alone, and a flat distribution.
    """
    fixed = k == 3
    yield from anchors or (ANCHORS if fixed else [[1.0] * k, *np.eye(k).tolist()])
    shape = concentration or (CONCENTRATION if fixed else [1.0] * k)
    draw = np.random.default_rng(seed)
    while True:
        yield draw.gamma(shape).tolist()


def candidates(names: list[str], samples: int = 32, least: float = 0.05, seed: int = 42, *, anchors: Sequence[Sequence[float]] | None = None, concentration: Sequence[float] | None = None) -> list[dict]:
    """Blends to try: the first ``samples`` of ``blend_points``, each weight at least ``least``, in every space."""
    if len(names) < 2 or samples < 1 or not 0 < least < 1 / len(names):
        raise ValueError("a blend has two names or more and room for its least weights")
    points = list(islice(blend_points(len(names), seed, anchors, concentration), samples))
    return [{"candidate": i, "space": space, "weights": dict(zip(names, floored(p, least), strict=True))} for i, (space, p) in enumerate(product(SPACES, points))]


def search(df: DataFrame, label: str, tried: list[dict]) -> DataFrame:
    """Per candidate: average precision, and F2, recall and precision at its best threshold, best candidate first.

    Every row is scored by every candidate (their number is a parameter), in one pass.
    """
    scores = F.array(*[F.struct(F.lit(c["candidate"]).alias("candidate"), F.round(blend(c["weights"], c["space"]), 12).alias("p")) for c in tried])
    long = df.select(F.col(label).alias("y"), F.inline(scores))
    out = average_precision(long, "y", "p", ["candidate"]).join(best_threshold(long, "y", "p", 2.0, ["candidate"]), "candidate")
    return out.orderBy(F.desc("average_precision"), F.desc("f_beta"), F.desc("recall"), F.desc("precision"), "candidate")


@dataclass(frozen=True)
class Hybrid:
    """A chosen blend with its threshold."""

    weights: dict[str, float]
    space: str
    threshold: float

    def score(self, df: DataFrame) -> DataFrame:
        return df.withColumn("hybrid_probability", blend(self.weights, self.space)).withColumn("predicted_fraud", F.col("hybrid_probability") >= self.threshold)

    def to_dict(self, components: dict[str, str]) -> dict:
        """With the digests of the components it was made for."""
        return sealed({"type": "hybrid", "version": 1, "weights": self.weights, "space": self.space, "threshold": self.threshold, "components": components})

    @classmethod
    def from_dict(cls, document: dict, components: dict[str, str]) -> Hybrid:
        d = opened(document, kind="hybrid", version=1)
        if d["components"] != components:
            raise ValueError("the components are not those the blend was made for")
        return cls(d["weights"], d["space"], d["threshold"])


def choose(df: DataFrame, label: str, tried: list[dict]) -> Hybrid:
    best = search(df, label, tried).first()
    chosen = next(c for c in tried if c["candidate"] == best["candidate"])
    return Hybrid(chosen["weights"], chosen["space"], best["threshold"])


#: What the reports of a blend's components must agree on.
LINEAGE = ("split_sha256", "schema_sha256")


def shared_lineage(reports: dict[str, dict]) -> dict:
    """The lineage that all components' reports have, after each was verified; they must be made from the same rows and features."""
    if len(reports) < 2:
        raise ValueError("a blend has two components or more")
    found = {name: opened(r, kind="model_report", version=1).get("lineage") or {} for name, r in reports.items()}
    first = next(iter(found.values()))
    if set(first) != set(LINEAGE) or not all(first.values()):
        raise ValueError("a report does not say what it was made from")
    if wrong := sorted(name for name, own in found.items() if own != first):
        raise ValueError(f"made from other rows or features: {', '.join(wrong)}")
    return first


def search_hybrid(validation: DataFrame, holdout: DataFrame, label: str, reports: dict[str, dict], *, samples: int = 32, least: float = 0.05, seed: int = 42) -> tuple[Hybrid, dict, dict]:
    """Choose a blend of the components' score columns on validation rows, then score the holdout once, with the frozen blend and
    threshold. Returns the blend, its document, and a sealed report with the lineage, the candidates and both evaluations."""
    lineage = shared_lineage(reports)
    tried = candidates(list(reports), samples, least, seed)
    for rows in (validation, holdout):
        for name in reports:
            check_probabilities(rows, label, name)
    table = [r.asDict() for r in search(validation, label, tried).collect()]  # a row per candidate
    best = next(c for c in tried if c["candidate"] == table[0]["candidate"])
    chosen = Hybrid(best["weights"], best["space"], table[0]["threshold"])
    document = chosen.to_dict({name: r["model_sha256"] for name, r in reports.items()})
    scored = {part: chosen.score(rows).select(label, "hybrid_probability") for part, rows in (("validation", validation), ("holdout", holdout))}
    found = {part: evaluate(rows, label, "hybrid_probability", threshold=chosen.threshold) for part, rows in scored.items()}
    report = {"type": "hybrid_report", "version": 1, "hybrid_sha256": document["sha256"], "lineage": lineage, "components": {name: r["sha256"] for name, r in reports.items()}, "candidates": table, **found}
    return chosen, document, sealed(report)


def linear_contributions(coefficients: dict[str, float]) -> Column:
    """(feature, contribution) of a linear model, for every row."""
    return F.array(*[F.struct(F.lit(f).alias("feature"), (F.col(f"`{f}`") * w).alias("contribution")) for f, w in coefficients.items()])


def top_drivers(contributions: Column, n: int = 8) -> Column:
    """The contributions of the largest size, largest first; ties by feature."""
    order = lambda x: F.struct((-F.abs(x["contribution"])).alias("a"), x["feature"].alias("f"), x["contribution"].alias("c"))
    ranked = F.slice(F.array_sort(F.transform(contributions, order)), 1, n)
    return F.transform(ranked, lambda x: F.struct(x["f"], x["c"])).cast("array<struct<feature:string,contribution:double>>")


def by_id(scored: DataFrame, ids: list[str], key: str = "prediction_id") -> DataFrame:
    """The scored rows of these predictions; each must be there once."""
    found = scored.filter(F.col(key).isin(ids))
    counts = {r[key]: r["count"] for r in found.groupBy(key).count().collect()}  # as many rows as ids
    if wrong := [i for i in ids if counts.get(i) != 1]:
        raise KeyError(f"not scored once: {', '.join(wrong)}")
    return found


def with_ids(scored: DataFrame, key: str, document: dict) -> DataFrame:
    """Scored rows with ``prediction_id`` (digest of the blend's document and the key) and ``scored_at_utc``."""
    return scored.withColumns({"prediction_id": F.sha2(F.concat_ws(":", F.lit(document["sha256"]), F.col(key).cast("string")).cast("binary"), 256), "scored_at_utc": F.date_format(F.to_utc_timestamp(F.current_timestamp(), F.current_timezone()), "yyyy-MM-dd'T'HH:mm:ss'Z'")})


def write_scored(scored: DataFrame, path: str, *, card: str = "cc_num", overwrite: bool = False) -> None:
    """Scored rows as CSV files with masked cards."""
    write_csv(review_table(scored, card) if card in scored.columns else scored, path, overwrite=overwrite)


def review_totals(scored: DataFrame) -> DataFrame:
    return scored.agg(F.count("*").alias("rows"), F.count_if("predicted_fraud").alias("flagged"), F.avg("hybrid_probability").alias("mean_risk"))


def review_table(scored: DataFrame, card: str = "cc_num") -> DataFrame:
    return scored.withColumn(card, mask_tail(F.col(card)))


def tradeoff(quality: DataFrame, latency: DataFrame, sizes: DataFrame) -> DataFrame:
    """Quality, latency and size of each model and batch size, best holdout precision first.

    A hybrid also occupies its components: ``sizes`` has (model, bytes, components array).
    """
    parts = sizes.select("model", F.explode_outer("components").alias("part")).join(sizes.select(F.col("model").alias("part"), F.col("bytes").alias("part_bytes")), "part", "left")
    extra = parts.groupBy("model").agg(F.coalesce(F.sum("part_bytes"), F.lit(0)).alias("more"))
    whole = sizes.join(extra, "model").select("model", (F.col("bytes") + F.col("more")).alias("bytes"))
    return quality.join(latency, "model").join(whole, "model").orderBy(F.desc("holdout_ap"), "model", "batch")
