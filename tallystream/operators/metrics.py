"""Metrics of probabilities against a binary label, from one count per distinct score."""

from __future__ import annotations

from dataclasses import asdict, dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.ranges import cuts, range_of
from tallystream.functions.scalars import safe_ratio

RECALL_TARGETS, PRECISION_TARGETS = (0.80, 0.90, 0.95), (0.50, 0.75, 0.90)
EPS = 2.220446049250313e-16


@dataclass(frozen=True)
class Threshold:
    threshold: float
    f_beta: float
    recall: float
    precision: float


def check_probabilities(df: DataFrame, label: str, p: str) -> None:
    """Raise unless scores are finite and in [0, 1], labels 0 or 1, and both classes occur."""
    bad, odd, good, poor = df.agg(
        F.count_if(F.col(p).isNull() | F.isnan(p) | (F.col(p) < 0) | (F.col(p) > 1)), F.count_if(~F.coalesce(F.col(label).isin(0, 1), F.lit(False))),
        F.count_if(F.col(label) == 0), F.count_if(F.col(label) == 1),
    ).first()
    if bad or odd or not good or not poor:
        raise ValueError("probabilities must be finite and in [0, 1], labels 0 or 1, and both classes must occur")


def _running(df: DataFrame, values: list[str], order: str, by: list[str], descending: bool) -> DataFrame:
    """Add running sums ``c_<value>`` over ``order`` within ``by``; equal orders must not repeat.

    Rows are summed within ranges of the order first, and the ranges' totals (a row each) are carried over.
    """
    key, at = F.desc(order) if descending else F.asc(order), range_of(F.col(order), cuts(df, order))
    # A generated column, since Spark may push what it infers from an aliased lambda across the join below to the wrong side.
    rows = df.select("*", F.explode(F.array(-at if descending else at)).alias("__p"))
    inside = Window.partitionBy(*by, "__p").orderBy(key).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*by).orderBy("__p").rowsBetween(Window.unboundedPreceding, -1)
    totals = rows.groupBy(*by, "__p").agg(*[F.sum(v).alias(f"__t_{v}") for v in values])
    before = totals.select(*by, "__p", *[F.coalesce(F.sum(f"__t_{v}").over(across), F.lit(0)).alias(f"__b_{v}") for v in values])
    out = rows.select("*", *[F.sum(v).over(inside).alias(f"__i_{v}") for v in values]).join(F.broadcast(before), [*by, "__p"])
    return out.select(*df.columns, *[(F.col(f"__i_{v}") + F.col(f"__b_{v}")).alias(f"c_{v}") for v in values])


def _rows_of(label: str, value: int, count: str | None) -> Column:
    """How many rows have this label; a row stands for ``count`` rows."""
    here = F.col(label) == value
    return F.count_if(here) if count is None else F.sum(F.when(here, F.col(count)).otherwise(0))


def score_counts(df: DataFrame, label: str, p: str, by: list[str] | None = None, count: str | None = None) -> DataFrame:
    return df.groupBy(*(by or []), F.col(p).alias("p")).agg(_rows_of(label, 1, count).alias("pos"), _rows_of(label, 0, count).alias("neg"))


def pr_curve(df: DataFrame, label: str, p: str, by: list[str] | None = None, count: str | None = None) -> DataFrame:
    """A row per distinct score as a threshold: tp, fp, precision, recall (and what ``by`` says). With ``count`` a row stands for that
    many."""
    by = by or []
    totals = df.groupBy(*by).agg(_rows_of(label, 1, count).alias("total"))
    rows = _running(score_counts(df, label, p, by, count), ["pos", "neg"], "p", by, True)
    rows = rows.join(F.broadcast(totals), by) if by else rows.crossJoin(F.broadcast(totals))  # one row
    tp, fp = F.col("c_pos"), F.col("c_neg")
    return rows.select(*by, F.col("p").alias("threshold"), tp.alias("tp"), fp.alias("fp"), safe_ratio(tp, tp + fp).alias("precision"), safe_ratio(tp, F.col("total")).alias("recall"), F.col("pos"), F.col("neg"), "total")


def f_beta(precision: Column, recall: Column, beta: float) -> Column:
    return safe_ratio((1 + beta**2) * precision * recall, beta**2 * precision + recall)


def best_threshold(df: DataFrame, label: str, p: str, beta: float = 2.0, by: list[str] | None = None) -> DataFrame:
    """The score of the largest F-beta as threshold; ties by recall, precision, and the larger threshold."""
    curve = pr_curve(df, label, p, by).withColumn("f", f_beta(F.col("precision"), F.col("recall"), beta))
    best = curve.groupBy(*(by or [])).agg(F.max(F.struct("f", "recall", "precision", "threshold")).alias("b"))
    return best.select(*(by or []), F.col("b.threshold").alias("threshold"), F.col("b.f").alias("f_beta"), F.col("b.recall").alias("recall"), F.col("b.precision").alias("precision"))


def select_threshold(df: DataFrame, label: str, p: str, beta: float = 2.0) -> Threshold:
    return Threshold(**best_threshold(df, label, p, beta).first().asDict())


def average_precision(df: DataFrame, label: str, p: str, by: list[str] | None = None, count: str | None = None) -> DataFrame:
    """Sum over thresholds of precision times the gain in recall. With ``count`` a row stands for that many."""
    gain = safe_ratio(F.col("pos"), F.col("total"))
    return pr_curve(df, label, p, by, count).groupBy(*(by or [])).agg(F.sum(F.col("precision") * gain).alias("average_precision"))


def pr_auc(df: DataFrame, label: str, p: str) -> DataFrame:
    """Area under precision by recall, by trapezoids from (recall 0, precision 1) on."""
    tp, fp = F.col("tp") - F.col("pos"), F.col("fp") - F.col("neg")
    before = F.when(tp + fp == 0, 1.0).otherwise(safe_ratio(tp, tp + fp))
    return pr_curve(df, label, p).agg(F.sum(safe_ratio(F.col("pos"), F.col("total")) * (F.col("precision") + before) / 2).alias("pr_auc"))


def roc_auc(df: DataFrame, label: str, p: str) -> DataFrame:
    """Share of pairs of a positive and a negative in the right order; equal scores count a half."""
    rows = _running(score_counts(df, label, p), ["neg", "pos"], "p", [], False)
    below = F.col("c_neg") - F.col("neg")
    sums = rows.agg(F.sum(F.col("pos") * below + F.col("pos") * F.col("neg") / 2).alias("pairs"), F.sum("pos").alias("a"), F.sum("neg").alias("b"))
    return sums.select(safe_ratio(F.col("pairs"), (F.col("a") * F.col("b")).cast("double")).alias("roc_auc"))


def calibration(df: DataFrame, label: str, p: str) -> DataFrame:
    """Brier score and log loss."""
    y, q = F.col(label).cast("double"), F.least(F.greatest(F.col(p), F.lit(EPS)), F.lit(1 - EPS))
    return df.agg(F.avg(F.pow(F.col(p) - y, 2)).alias("brier"), F.avg(-(y * F.ln(q) + (1 - y) * F.ln(1 - q))).alias("log_loss"))


def operating_point(df: DataFrame, label: str, p: str, thresholds: list[float]) -> DataFrame:
    """One row per threshold: confusion counts and rates."""
    flagged, bad = [F.col(p) >= t for t in thresholds], F.col(label) == 1
    cells = [F.struct(F.lit(t).alias("threshold"), F.count_if(f & bad).alias("tp"), F.count_if(f & ~bad).alias("fp"), F.count_if(~f & bad).alias("fn"), F.count_if(~f & ~bad).alias("tn")) for t, f in zip(thresholds, flagged, strict=True)]
    rows = df.agg(*[c.alias(f"c{i}") for i, c in enumerate(cells)]).select(F.inline(F.array(*[F.col(f"c{i}") for i in range(len(cells))])))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    precision, recall = safe_ratio(tp, tp + fp), safe_ratio(tp, tp + fn)
    return rows.select(
        "*", precision.alias("precision"), recall.alias("recall"), safe_ratio(tn, tn + fp).alias("specificity"), safe_ratio(fp, tn + fp).alias("fpr"), safe_ratio(fn, tp + fn).alias("fnr"),
        f_beta(precision, recall, 1).alias("f1"), f_beta(precision, recall, 2).alias("f2"), safe_ratio(tp + fp, tp + fp + fn + tn).alias("alert_rate"),
    )


def at_targets(df: DataFrame, label: str, p: str) -> DataFrame:
    """Largest precision at each recall target and largest recall at each precision target; null where none reaches it."""
    curve = pr_curve(df, label, p)
    out = [F.max(F.when(F.col("recall") >= t, F.col("precision"))).alias(f"precision_at_recall_{round(100 * t)}") for t in RECALL_TARGETS]
    return curve.agg(*out, *[F.max(F.when(F.col("precision") >= t, F.col("recall"))).alias(f"recall_at_precision_{round(100 * t)}") for t in PRECISION_TARGETS])


def evaluate(df: DataFrame, label: str, p: str, threshold: float | None = None, beta: float = 2.0) -> dict:
    """The whole report of a model on labelled scores."""
    check_probabilities(df, label, p)
    chosen = select_threshold(df, label, p, beta) if threshold is None else None
    at = chosen.threshold if chosen else threshold
    points = operating_point(df, label, p, [at, 0.5]).collect()
    out = {"threshold": at, "selected": asdict(chosen) if chosen else None, "at_threshold": points[0].asDict(), "at_half": points[1].asDict()}
    for part in (average_precision(df, label, p), pr_auc(df, label, p), roc_auc(df, label, p), calibration(df, label, p), at_targets(df, label, p)):
        out |= part.first().asDict()
    return out


def evaluation_matrix(df: DataFrame, reports: dict[str, dict]) -> DataFrame:
    """One row per model, by name."""
    names = ["average_precision", "pr_auc", "roc_auc", "brier", "log_loss", "threshold"]
    rows = [(m, *[float(r[n]) for n in names], float(r["at_threshold"]["recall"]), float(r["at_threshold"]["precision"])) for m, r in sorted(reports.items())]
    return df.sparkSession.createDataFrame(rows, "model string, " + ", ".join(f"{n} double" for n in [*names, "recall", "precision"]))
