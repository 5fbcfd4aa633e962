"""Metrics, drift, blending, reviews and their tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators import drift, fusion, metrics
from tallystream.plans import tables
from tallystream.sources import ledger


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a label and three made-up scores that know something of it; many scores tie."""
    y = (F.col("o_orderstatus") == "F").cast("int")
    score = lambda a, gain: ((F.col("o_orderkey") * a % (1000 - gain)) + gain * y) / F.lit(1000.0)
    return tables.orders(spark, sf_dir).select("o_orderkey", "o_custkey", "t", "o_totalprice", y.alias("y"), score(37, 300).alias("p"), score(91, 200).alias("p2"), score(53, 120).alias("p3"))


_S = "(SELECT *, (o_orderkey * 37 % 700 + 300 * y) / 1000.0 AS p, (o_orderkey * 91 % 800 + 200 * y) / 1000.0 AS p2, (o_orderkey * 53 % 880 + 120 * y) / 1000.0 AS p3 FROM (SELECT *, CAST(o_orderstatus = 'F' AS INTEGER) AS y, epoch_us(o_orderdate) // 1000000 AS t FROM orders))"


def pr_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.pr_curve(scored(spark, sf_dir), "y", "p")
    return out.select("threshold", "tp", "fp", F.round("precision", 6).alias("precision"), F.round("recall", 6).alias("recall"))


def fbeta_threshold(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.best_threshold(scored(spark, sf_dir), "y", "p")
    return out.select("threshold", *[F.round(c, 6).alias(c) for c in ("f_beta", "recall", "precision")])


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(scored(spark, sf_dir), "y", "p").select(F.round("average_precision", 6).alias("average_precision"))


def pr_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.pr_auc(scored(spark, sf_dir), "y", "p").select(F.round("pr_auc", 6).alias("pr_auc"))


def roc_auc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(scored(spark, sf_dir), "y", "p").select(F.round("roc_auc", 6).alias("roc_auc"))


def calibration(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.calibration(scored(spark, sf_dir), "y", "p").select(F.round("brier", 6).alias("brier"), F.round("log_loss", 6).alias("log_loss"))


_RATES = ("precision", "recall", "specificity", "fpr", "fnr", "f1", "f2", "alert_rate")


def operating_point(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.operating_point(scored(spark, sf_dir), "y", "p", [0.35, 0.5])
    return out.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 6).alias(c) for c in _RATES])


def precision_at_recall(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = metrics.at_targets(scored(spark, sf_dir), "y", "p")
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


_FEATURES = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """Line items before and after a date; prices of the later ones are moved."""
    rows, at = tables.lineitem(spark, sf_dir), F.lit("1998-01-01").cast("timestamp_ntz")
    return rows.filter(F.col("l_shipdate") < at), rows.filter(F.col("l_shipdate") >= at).withColumn("l_extendedprice", F.col("l_extendedprice") * 1.4)


def psi_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drift.feature_drift(*_windows(spark, sf_dir), _FEATURES)
    return out.select("feature", F.round("psi", 6).alias("psi"), "status", F.round("mean_shift", 6).alias("mean_shift"))


def drift_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drift.drift_summary(drift.feature_drift(*_windows(spark, sf_dir), _FEATURES))
    return out.select("stable", "warning", "critical", F.round("mean_psi", 6).alias("mean_psi"), F.round("max_psi", 6).alias("max_psi"), "overall")


def ks_wasserstein(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = drift.distribution_distances(*_windows(spark, sf_dir), "l_quantity")
    return out.select(F.round("ks", 6).alias("ks"), F.round("wasserstein", 6).alias("wasserstein"), "n_reference", "n_current")


def score_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("o_orderkey", F.round(drift.shifted_score(F.col("p"), 0.75), 6).alias("shifted"))


_WEIGHTS = {"p": 0.5, "p2": 0.3, "p3": 0.2}


def blend_probability(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("o_orderkey", F.round(fusion.blend(_WEIGHTS), 6).alias("blend"))


def blend_logit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scored(spark, sf_dir).select("o_orderkey", F.round(fusion.blend(_WEIGHTS, "logit"), 6).alias("blend"))


_TRIED = [{"candidate": i, "space": "probability", "weights": dict(zip(("p", "p2", "p3"), w, strict=True))} for i, w in enumerate([(1, 1, 1), (8, 1, 1), (1, 8, 1), (1, 1, 8)])]


def blend_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.search(scored(spark, sf_dir), "y", _TRIED)
    return out.select("candidate", *[F.round(c, 6).alias(c) for c in ("average_precision", "f_beta", "recall", "precision")])


def top_drivers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two largest contributions to a linear score of each order."""
    parts = fusion.linear_contributions({"p": 1.5, "p2": -2.0, "p3": 0.25})
    rows = scored(spark, sf_dir).select("o_orderkey", F.posexplode(fusion.top_drivers(parts, 2)).alias("rank", "d"))
    return rows.select("o_orderkey", F.col("rank").cast("long").alias("rank"), "d.feature", (F.round("d.contribution", 6) + 0.0).alias("contribution"))


_LEDGER = {"key": "user_id", "at": "t", "created": "created", "label": "event_type", "fixed": ["value"], "order": ["ts", "event_id"]}


def _reviews(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = tables.events(spark, sf_dir).select("user_id", "t", F.col("t").alias("created"), "value", "event_type", "event_id", "ts")
    return rows.filter("event_id % 3 = 0"), rows.filter("event_id % 3 <> 0")


def feedback_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews merged by key: first value, last label. Of the reviews of a first second the first by full time counts."""
    return ledger.merge(*_reviews(spark, sf_dir), **_LEDGER)


def feedback_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ledger.newest(ledger.merge(*_reviews(spark, sf_dir), **_LEDGER), 20, key="user_id", at="t").select("user_id", "t", "event_type")


def review_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = fusion.review_totals(fusion.Hybrid(_WEIGHTS, "logit", 0.4).score(scored(spark, sf_dir)))
    return out.select("rows", "flagged", F.round("mean_risk", 6).alias("mean_risk"))


def operational_tradeoff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality joined with latency and size; a hybrid also counts the size of its parts."""
    quality = metrics.average_precision(scored(spark, sf_dir).select("y", F.inline(F.array(*[F.struct(F.lit(m).alias("model"), F.col(m).alias("s")) for m in ("p", "p2", "p3")]))), "y", "s", ["model"]).withColumnRenamed("average_precision", "holdout_ap")
    latency = spark.createDataFrame([(m, b, x) for m, x in (("p", 1.0), ("p2", 2.0), ("p3", 4.0)) for b in (1, 256)], "model string, batch int, ms double")
    sizes = spark.createDataFrame([("p", 100, ["p2", "p3"]), ("p2", 20, []), ("p3", 5, [])], "model string, bytes long, components array<string>")
    return fusion.tradeoff(quality, latency, sizes).select("model", "batch", F.round("holdout_ap", 6).alias("holdout_ap"), "ms", "bytes")


QUERIES = {
    f.__name__: f
    for f in (
        pr_curve, fbeta_threshold, average_precision, pr_auc, roc_auc, calibration, operating_point, precision_at_recall, psi_features, drift_summary, ks_wasserstein, score_shift,
        blend_probability, blend_logit, blend_search, top_drivers, feedback_merge, feedback_latest, review_totals, operational_tradeoff,
    )
}


def _curve(source: str = _S, p: str = "p") -> str:
    return f"""(SELECT p AS threshold, pos, neg, tp, fp, total, tp / (tp + fp) AS precision, tp / total AS recall FROM (
      SELECT *, sum(pos) OVER (ORDER BY p DESC) AS tp, sum(neg) OVER (ORDER BY p DESC) AS fp, sum(pos) OVER () AS total FROM (SELECT {p} AS p, sum(y) AS pos, sum(1 - y) AS neg FROM {source} GROUP BY 1)))"""


_F2 = "(CASE WHEN precision + recall = 0 THEN 0 ELSE 5 * precision * recall / (4 * precision + recall) END)"


def _best(curve: str) -> str:
    return f"(SELECT threshold, {_F2} AS f_beta, recall, precision FROM {curve} ORDER BY f_beta DESC, recall DESC, precision DESC, threshold DESC LIMIT 1)"


def _ap(curve: str) -> str:
    return f"(SELECT sum(precision * pos / total) FROM {curve})"


def _point(t: float) -> str:
    return f"SELECT {t}::DOUBLE AS threshold, count(*) FILTER (WHERE p >= {t} AND y = 1) AS tp, count(*) FILTER (WHERE p >= {t} AND y = 0) AS fp, count(*) FILTER (WHERE p < {t} AND y = 1) AS fn, count(*) FILTER (WHERE p < {t} AND y = 0) AS tn FROM {_S}"


def _logit(x: str) -> str:
    return f"ln(least(greatest({x}, 1e-7), 1 - 1e-7) / (1 - least(greatest({x}, 1e-7), 1 - 1e-7)))"


_PR, _MEAN = _curve(), f"(0.5 * {_logit('p')} + 0.3 * {_logit('p2')} + 0.2 * {_logit('p3')})"
_REF, _CUR = "(SELECT * FROM lineitem WHERE l_shipdate < TIMESTAMP '1998-01-01')", "(SELECT * REPLACE (l_extendedprice * 1.4 AS l_extendedprice) FROM lineitem WHERE l_shipdate >= TIMESTAMP '1998-01-01')"
_LONG = lambda s: "(" + " UNION ALL ".join(f"SELECT '{f}' AS feature, {f} AS value FROM {s}" for f in _FEATURES) + ")"


def _shares(side: str, name: str) -> str:
    return f"""SELECT feature, bin, greatest(n / sum(n) OVER (PARTITION BY feature), 1e-6) AS raw FROM (SELECT b.feature, b.bin, count(v.value) AS n FROM b LEFT JOIN {side} v ON v.feature = b.feature AND len(list_filter(b.edges, lambda e: e <= v.value)) = b.bin GROUP BY ALL)"""


_PSI = f"""WITH a AS MATERIALIZED (SELECT * FROM {_LONG(_REF)}), c AS MATERIALIZED (SELECT * FROM {_LONG(_CUR)}),
e AS (SELECT feature, list_sort(list_distinct(quantile_cont(value, [0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]))) AS edges FROM a GROUP BY 1),
b AS (SELECT feature, edges, unnest(range(len(edges) + 1)) AS bin FROM e),
r AS (SELECT feature, bin, raw / sum(raw) OVER (PARTITION BY feature) AS r FROM ({_shares('a', 'r')})),
k AS (SELECT feature, bin, raw / sum(raw) OVER (PARTITION BY feature) AS k FROM ({_shares('c', 'k')})),
p AS (SELECT feature, sum((k - r) * ln(k / r)) AS psi FROM r JOIN k USING (feature, bin) GROUP BY 1),
m AS (SELECT feature, avg(value) AS mean, CASE WHEN stddev_pop(value) > 0 THEN stddev_pop(value) ELSE 1 END AS std FROM a GROUP BY 1),
d AS (SELECT feature, psi, CASE WHEN psi >= 0.25 THEN 'critical' WHEN psi >= 0.1 THEN 'warning' ELSE 'stable' END AS status, (n.now - mean) / std AS mean_shift FROM p JOIN m USING (feature) JOIN (SELECT feature, avg(value) AS now FROM c GROUP BY 1) n USING (feature))"""
_U = "(SELECT user_id, epoch_us(ts) // 1000000 AS t, value, event_type FROM events)"
_MERGED = f"(SELECT user_id, max(t) AS t, min(t) AS created, arg_min(value, t) AS value, arg_max(event_type, (t, event_type)) AS event_type FROM {_U} GROUP BY 1)"
_WSQL = [(1, 1, 1), (8, 1, 1), (1, 8, 1), (1, 1, 8)]


def _searched(i: int, w: tuple[int, ...]) -> str:
    total = sum(w)
    mean = " + ".join(f"{x}::DOUBLE / {total} * {p}" for x, p in zip(w, ("p", "p2", "p3"), strict=True))
    curve = _curve(_S, f"round({mean}, 12)")
    return f"SELECT {i} AS candidate, round({_ap(curve)}, 6) AS average_precision, round(f_beta, 6) AS f_beta, round(recall, 6) AS recall, round(precision, 6) AS precision FROM {_best(curve)}"


SQL = {
    "pr_curve": f"SELECT threshold, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, round(precision, 6) AS precision, round(recall, 6) AS recall FROM {_PR}",
    "fbeta_threshold": f"SELECT threshold, round(f_beta, 6) AS f_beta, round(recall, 6) AS recall, round(precision, 6) AS precision FROM {_best(_PR)}",
    "average_precision": f"SELECT round({_ap(_PR)}, 6) AS average_precision",
    "pr_auc": f"SELECT round(sum(pos / total * (precision + before) / 2), 6) AS pr_auc FROM (SELECT *, CASE WHEN tp - pos + fp - neg = 0 THEN 1.0 ELSE (tp - pos) / (tp - pos + fp - neg) END AS before FROM {_PR})",
    "roc_auc": f"SELECT round(sum(pos * (below + neg / 2)) / (sum(pos) * sum(neg)), 6) AS roc_auc FROM (SELECT pos, neg, sum(neg) OVER (ORDER BY threshold) - neg AS below FROM {_PR})",
    "calibration": f"SELECT round(avg(pow(p - y, 2)), 6) AS brier, round(avg(-(y * ln(q) + (1 - y) * ln(1 - q))), 6) AS log_loss FROM (SELECT p, y, least(greatest(p, 2.220446049250313e-16), 1 - 2.220446049250313e-16) AS q FROM {_S})",
    "operating_point": f"""SELECT threshold, tp, fp, fn, tn, round(precision, 6) AS precision, round(recall, 6) AS recall, round(tn / (tn + fp), 6) AS specificity, round(fp / (tn + fp), 6) AS fpr, round(fn / (tp + fn), 6) AS fnr,
      round(2 * precision * recall / (precision + recall), 6) AS f1, round({_F2}, 6) AS f2, round((tp + fp) / (tp + fp + fn + tn), 6) AS alert_rate FROM (SELECT *, tp / (tp + fp) AS precision, tp / (tp + fn) AS recall FROM ({_point(0.35)} UNION ALL {_point(0.5)}))""",
    "precision_at_recall": "SELECT "
    + ", ".join([f"round(max(precision) FILTER (WHERE recall >= {t}), 6) AS precision_at_recall_{round(100 * t)}" for t in metrics.RECALL_TARGETS] + [f"round(max(recall) FILTER (WHERE precision >= {t}), 6) AS recall_at_precision_{round(100 * t)}" for t in metrics.PRECISION_TARGETS])
    + f" FROM {_PR}",
    "psi_features": _PSI + " SELECT feature, round(psi, 6) AS psi, status, round(mean_shift, 6) AS mean_shift FROM d",
    "drift_summary": _PSI
    + " SELECT count(*) FILTER (WHERE status = 'stable') AS stable, count(*) FILTER (WHERE status = 'warning') AS warning, count(*) FILTER (WHERE status = 'critical') AS critical, round(avg(psi), 6) AS mean_psi, round(max(psi), 6) AS max_psi, CASE WHEN count(*) FILTER (WHERE status = 'critical') > 0 THEN 'critical' WHEN count(*) FILTER (WHERE status = 'warning') > 0 THEN 'warning' ELSE 'stable' END AS overall FROM d",
    "ks_wasserstein": f"""WITH v AS (SELECT v, sum(a) AS a, sum(b) AS b FROM (SELECT l_quantity AS v, 1 AS a, 0 AS b FROM {_REF} UNION ALL SELECT l_quantity, 0, 1 FROM {_CUR}) GROUP BY 1),
      g AS (SELECT v, abs(sum(a) OVER (ORDER BY v) / sum(a) OVER () - sum(b) OVER (ORDER BY v) / sum(b) OVER ()) AS gap, coalesce(lead(v) OVER (ORDER BY v) - v, 0) AS step FROM v)
      SELECT round(max(gap), 6) AS ks, round(sum(gap * step), 6) AS wasserstein, (SELECT CAST(sum(a) AS BIGINT) FROM v) AS n_reference, (SELECT CAST(sum(b) AS BIGINT) FROM v) AS n_current FROM g""",
    "score_shift": f"SELECT o_orderkey, round(1 / (1 + exp(-least(greatest({_logit('p')} + 0.75, -40), 40))), 6) AS shifted FROM {_S}",
    "blend_probability": f"SELECT o_orderkey, round(0.5 * p + 0.3 * p2 + 0.2 * p3, 6) AS blend FROM {_S}",
    "blend_logit": f"SELECT o_orderkey, round(1 / (1 + exp(-{_MEAN})), 6) AS blend FROM {_S}",
    "blend_search": " UNION ALL ".join(_searched(i, w) for i, w in enumerate(_WSQL)),
    "top_drivers": f"""SELECT o_orderkey, rank, feature, round(c, 6) + 0.0 AS contribution FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY abs(c) DESC, feature) - 1 AS rank FROM (
      SELECT o_orderkey, 'p' AS feature, p * 1.5 AS c FROM {_S} UNION ALL SELECT o_orderkey, 'p2', p2 * -2.0 FROM {_S} UNION ALL SELECT o_orderkey, 'p3', p3 * 0.25 FROM {_S})) WHERE rank < 2""",
    "feedback_merge": f"SELECT * FROM {_MERGED}",
    "feedback_latest": f"SELECT user_id, t, event_type FROM {_MERGED} ORDER BY t DESC, user_id DESC LIMIT 20",
    "review_totals": f"SELECT count(*) AS rows, count(*) FILTER (WHERE h >= 0.4) AS flagged, round(avg(h), 6) AS mean_risk FROM (SELECT 1 / (1 + exp(-{_MEAN})) AS h FROM {_S})",
    "operational_tradeoff": "SELECT model, CAST(batch AS INTEGER) AS batch, holdout_ap, ms, CAST(bytes AS BIGINT) AS bytes FROM ("
    + " UNION ALL ".join(f"SELECT '{m}' AS model, round({_ap(_curve(_S, m))}, 6) AS holdout_ap, {ms}::DOUBLE AS ms, {size} AS bytes" for m, ms, size in (("p", 1, 125), ("p2", 2, 20), ("p3", 4, 5)))
    + "), (VALUES (1), (256)) AS b(batch)",
}
