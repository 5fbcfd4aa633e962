"""Drift of features and scores against a reference window."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.ranges import cuts, range_of
from tallystream.functions.scalars import drift_status, logit, sigmoid
from tallystream.functions.selection import quantiles
from tallystream.operators.checks import enforce
from tallystream.operators.preprocess import number_rules
from tallystream.operators.profile import bottom_k
from tallystream.sources.artifacts import opened, sealed
from tallystream.sources.shared import written


@dataclass(frozen=True)
class DriftConfig:
    bins: int = 10
    epsilon: float = 1e-6
    warning: float = 0.10
    critical: float = 0.25
    top: int = 15
    max_rows: int = 100_000
    seed: int = 42

    def __post_init__(self):
        if self.bins < 2 or not 0 < self.epsilon < 1 or not 0 < self.warning < self.critical:
            raise ValueError("bins, epsilon and thresholds must be ordered and positive")


def unpivot(df: DataFrame, features: list[str]) -> DataFrame:
    """(feature, value), nulls left out."""
    rows = F.array(*[F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features])
    return df.select(F.inline(rows)).filter("value is not null")


def bin_edges(df: DataFrame, features: list[str], bins: int) -> DataFrame:
    """(feature, edges): distinct inner quantiles of each feature, ascending. Found at once; a row per feature."""
    numbers = df.select(*[F.col(f).cast("double").alias(f"c{i}") for i, f in enumerate(features)])
    columns = {f: F.when(~F.isnan(f"c{i}"), F.col(f"c{i}")) for i, f in enumerate(features)}
    found = quantiles(numbers, columns, [i / bins for i in range(1, bins)])
    return df.sparkSession.createDataFrame([(f, sorted(set(v))) for f, v in found.items()], "feature string, edges array<double>")


def bin_of(value: Column, edges: Column) -> Column:
    """Number of edges that are not above the value: bins are closed on the left, the first and last one are open."""
    return F.size(F.filter(edges, lambda e: e <= value))


def proportions(long: DataFrame, edges: DataFrame, epsilon: float) -> DataFrame:
    """(feature, bin, share): shares of all bins, at least epsilon each and adding up to 1."""
    counts = long.join(F.broadcast(edges), "feature").groupBy("feature", bin_of(F.col("value"), F.col("edges")).alias("bin")).agg(F.count("*").alias("n"))
    every = edges.select("feature", F.explode(F.sequence(F.lit(0), F.size("edges"))).alias("bin"))
    whole = Window.partitionBy("feature")
    share = F.greatest(F.coalesce(F.col("n"), F.lit(0)) / F.sum(F.coalesce("n", F.lit(0))).over(whole), F.lit(epsilon))
    return every.join(counts, ["feature", "bin"], "left").withColumn("raw", share).select("feature", "bin", (F.col("raw") / F.sum("raw").over(whole)).alias("share"))


def psi(reference: DataFrame, current: DataFrame, edges: DataFrame, epsilon: float = 1e-6) -> DataFrame:
    """(feature, psi): sum over bins of (c - r) ln(c / r)."""
    r, c = proportions(reference, edges, epsilon).withColumnRenamed("share", "r"), proportions(current, edges, epsilon).withColumnRenamed("share", "c")
    return r.join(c, ["feature", "bin"]).groupBy("feature").agg(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))).alias("psi"))


def moments(long: DataFrame) -> DataFrame:
    """(feature, mean, std); a constant feature has the deviation 1."""
    spread = F.stddev_pop("value")
    return long.groupBy("feature").agg(F.avg("value").alias("mean"), F.when(spread > 0, spread).otherwise(1.0).alias("std"))


def feature_drift(reference: DataFrame, current: DataFrame, features: list[str], config: DriftConfig = DriftConfig()) -> DataFrame:
    """Per feature: psi, status, and the shift of the mean in reference deviations."""
    a, b = unpivot(reference, features), unpivot(current, features)
    shift = moments(a).join(b.groupBy("feature").agg(F.avg("value").alias("now")), "feature").select("feature", ((F.col("now") - F.col("mean")) / F.col("std")).alias("mean_shift"))
    out = psi(a, b, bin_edges(reference, features, config.bins), config.epsilon).join(shift, "feature")
    return out.select("feature", "psi", drift_status(F.col("psi"), config.warning, config.critical).alias("status"), "mean_shift")


def top_drift(drift: DataFrame, n: int = 15) -> DataFrame:
    return drift.orderBy(F.desc("psi"), "feature").limit(n)


def drift_summary(drift: DataFrame) -> DataFrame:
    """Counts by status, mean and largest psi, and the worst status as the overall one."""
    count = lambda s: F.count_if(F.col("status") == s)
    worst = F.when(count("critical") > 0, "critical").when(count("warning") > 0, "warning").otherwise("stable")
    return drift.agg(count("stable").alias("stable"), count("warning").alias("warning"), count("critical").alias("critical"), F.avg("psi").alias("mean_psi"), F.max("psi").alias("max_psi"), worst.alias("overall"))


def distribution_distances(reference: DataFrame, current: DataFrame, value: str) -> DataFrame:
    """One row: Kolmogorov-Smirnov statistic, Wasserstein distance and row counts, from counts of distinct values."""
    from tallystream.operators.metrics import _running

    side = lambda df, n: df.select(F.col(value).cast("double").alias("v"), F.lit(n).alias("s")).filter("v is not null")
    counts = side(reference, 0).unionByName(side(current, 1)).groupBy("v").agg(F.count_if(F.col("s") == 0).alias("a"), F.count_if(F.col("s") == 1).alias("b"))
    total = counts.agg(F.sum("a").alias("n_a"), F.sum("b").alias("n_b"))
    rows = _running(counts, ["a", "b"], "v", [], False)
    # The next distinct value: inside a range by lead, across ranges the next one's first.
    ranged = rows.select("*", F.explode(F.array(range_of(F.col("v"), cuts(counts, "v")))).alias("__p"))
    firsts = ranged.groupBy("__p").agg(F.min("v").alias("first")).withColumn("after", F.lead("first").over(Window.orderBy("__p"))).select("__p", "after")
    nexts = ranged.withColumn("next", F.lead("v").over(Window.partitionBy("__p").orderBy("v"))).join(F.broadcast(firsts), "__p").crossJoin(F.broadcast(total))
    gap = F.abs(F.col("c_a") / F.col("n_a") - F.col("c_b") / F.col("n_b"))
    step = F.coalesce(F.coalesce("next", "after") - F.col("v"), F.lit(0.0))
    return nexts.agg(F.max(gap).alias("ks"), F.sum(gap * step).alias("wasserstein"), F.max("n_a").alias("n_reference"), F.max("n_b").alias("n_current"))


def ks_p_value(statistic: float, n: int, m: int) -> float:
    """Asymptotic two-sided p-value: the Kolmogorov series."""
    z = statistic * math.sqrt(n * m / (n + m))
    if z < 0.2:
        return 1.0
    return min(1.0, max(0.0, 2 * sum((-1) ** (k - 1) * math.exp(-2 * (k * z) ** 2) for k in range(1, 101))))


def score_drift(reference: DataFrame, current: DataFrame, p: str, config: DriftConfig = DriftConfig()) -> dict:
    a, b = unpivot(reference, [p]), unpivot(current, [p])
    value = psi(a, b, bin_edges(reference, [p], config.bins), config.epsilon).first()["psi"]
    row = distribution_distances(reference, current, p).first()
    status = "critical" if value >= config.critical else "warning" if value >= config.warning else "stable"
    return {"psi": value, "status": status, "ks": row["ks"], "ks_p_value": ks_p_value(row["ks"], row["n_reference"], row["n_current"]), "wasserstein": row["wasserstein"]}


#: Name of the scores in tables of the detector.
SCORE = "__score"


def _score_rules(p: Column) -> dict[str, Column]:
    return {"score": p.isNotNull() & ~F.isnan(p) & p.between(0, 1)}


def _score_reference(rows: DataFrame, config: DriftConfig) -> dict:
    """Edges, shares and the values of the sampled scores, of which there are at most ``config.max_rows``."""
    edges = bin_edges(rows, [SCORE], config.bins)
    shares = [r["share"] for r in proportions(unpivot(rows, [SCORE]), edges, config.epsilon).orderBy("bin").collect()]
    return {"edges": list(edges.first()["edges"]), "shares": shares, "sample": sorted(r[0] for r in rows.select(SCORE).collect())}


class DriftDetector:
    """Reference edges, proportions and moments of each feature, and edges, proportions and a sample of the scores, kept small,
    and evaluated against later windows. ``context`` says what they were made from."""

    def __init__(self, features: list[str], edges: dict, shares: dict, stats: dict, config: DriftConfig, predictions: dict | None = None, context: dict | None = None):
        self.features, self.edges, self.shares, self.stats, self.config = features, edges, shares, stats, config
        self.predictions, self.context = predictions, context or {}

    @classmethod
    def fit(cls, df: DataFrame, features: list[str], key: str, config: DriftConfig = DriftConfig(), *, p: str | None = None, context: dict | None = None) -> DriftDetector:
        """From at most ``config.max_rows`` rows of the smallest hash of the key; scores of the same rows if ``p`` names them."""
        if len(set(features)) < len(features):
            raise ValueError("features repeat")
        n, scored = df.count(), [F.col(p).cast("double").alias(SCORE)] if p else []
        if p:
            enforce(df, _score_rules(F.col(p)))
        rows = written(bottom_k(df, key, config.max_rows, config.seed).select(*features, *scored), "drift-sample")
        enforce(rows, number_rules(rows, features))
        long, edges = unpivot(rows, features), bin_edges(rows, features, config.bins)
        shares: dict = {}
        for r in proportions(long, edges, config.epsilon).orderBy("feature", "bin").collect():
            shares.setdefault(r["feature"], []).append(r["share"])
        stats = {r["feature"]: [r["mean"], r["std"]] for r in moments(long).collect()}
        predictions = _score_reference(rows, config) if p else None
        context = (context or {}) | {"rows_available": n, "rows_sampled": rows.count()}
        return cls(features, {r["feature"]: list(r["edges"]) for r in edges.collect()}, shares, stats, config, predictions, context)

    def evaluate_scores(self, df: DataFrame, key: str, p: str) -> dict:
        """Drift of the scores of a window: psi over the reference's bins, status, and distances from the reference's sample."""
        if self.predictions is None:
            raise ValueError("the detector was fitted without scores")
        enforce(df, _score_rules(F.col(p)))
        spark, config = df.sparkSession, self.config
        now = written(bottom_k(df, key, config.max_rows, config.seed).select(F.col(p).cast("double").alias(SCORE)), "drift-scores")
        if now.isEmpty():
            raise ValueError("a window needs scores")
        edges = spark.createDataFrame([(SCORE, self.predictions["edges"])], "feature string, edges array<double>")
        shares = [r["share"] for r in proportions(unpivot(now, [SCORE]), edges, config.epsilon).orderBy("bin").collect()]
        value = sum((c - r) * math.log(c / r) for r, c in zip(self.predictions["shares"], shares, strict=True))
        reference = spark.createDataFrame([(v,) for v in self.predictions["sample"]], f"{SCORE} double")
        row = distribution_distances(reference, now, SCORE).first()
        status = "critical" if value >= config.critical else "warning" if value >= config.warning else "stable"
        return {"psi": value, "status": status, "ks": row["ks"], "ks_p_value": ks_p_value(row["ks"], row["n_reference"], row["n_current"]), "wasserstein": row["wasserstein"], "rows_sampled": row["n_current"]}

    def report(self, df: DataFrame, key: str, p: str, window: str) -> dict:
        """A window's features by falling psi, its scores, and the worst status of all of them."""
        found = written(self.evaluate(df, key), "drift-features")
        summary, scores = drift_summary(found).first().asDict(), self.evaluate_scores(df, key, p)
        overall = next(s for s in ("critical", "warning", "stable") if s in (summary["overall"], scores["status"]))
        return {"window": window, "rows": df.count(), "overall": overall, "summary": summary, "top": [r.asDict() for r in top_drift(found, self.config.top).collect()], "scores": scores}

    def evaluate(self, df: DataFrame, key: str) -> DataFrame:
        """Per feature: psi, status and mean shift."""
        spark, rows = df.sparkSession, bottom_k(df, key, self.config.max_rows, self.config.seed)
        enforce(rows, number_rules(rows, self.features))
        long = unpivot(rows, self.features)
        edges = spark.createDataFrame(list(self.edges.items()), "feature string, edges array<double>")
        known = spark.createDataFrame([(f, i, s) for f, shares in self.shares.items() for i, s in enumerate(shares)], "feature string, bin int, r double")
        base = spark.createDataFrame([(f, *s) for f, s in self.stats.items()], "feature string, mean double, std double")
        now = proportions(long, edges, self.config.epsilon).withColumnRenamed("share", "c")
        value = known.join(now, ["feature", "bin"]).groupBy("feature").agg(F.sum((F.col("c") - F.col("r")) * F.ln(F.col("c") / F.col("r"))).alias("psi"))
        shift = long.groupBy("feature").agg(F.avg("value").alias("now")).join(base, "feature").select("feature", ((F.col("now") - F.col("mean")) / F.col("std")).alias("mean_shift"))
        return value.join(shift, "feature").select("feature", "psi", drift_status(F.col("psi"), self.config.warning, self.config.critical).alias("status"), "mean_shift")

    def to_dict(self) -> dict:
        return sealed({"type": "drift", "version": 1, "features": self.features, "edges": self.edges, "shares": self.shares, "stats": self.stats, "config": vars(self.config), "predictions": self.predictions, "context": self.context})

    @classmethod
    def from_dict(cls, document: dict) -> DriftDetector:
        d = opened(document, kind="drift", version=1)
        return cls(d["features"], d["edges"], d["shares"], d["stats"], DriftConfig(**d["config"]), d.get("predictions"), d.get("context"))


def shifted_score(p: Column, by: float) -> Column:
    """A probability moved by so much log-odds."""
    return sigmoid(logit(p) + by)


def injected_shift(df: DataFrame, features: list[str], stats: dict[str, list[float]], p: str, *, deviations: float = 1.5, log_odds: float = 0.75) -> DataFrame:
    """The rows of a made-up shift: features moved by deviations of the reference, scores by log-odds."""
    return df.withColumns({f: F.col(f) + deviations * stats[f][1] for f in features} | {p: shifted_score(F.col(p), log_odds)})


