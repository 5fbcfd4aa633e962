"""Splits, fitted statistics, encodings and imbalance control over the tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators import imbalance, preprocess, split
from tallystream.plans import tables
from tallystream.sources.shared import new_path

_SPLIT = split.SplitConfig(0.2, "t", "o_orderdate", "label", "o_orderkey")
_CONFIG = preprocess.PreprocessConfig(numeric=("o_totalprice", "age"), frequency=("o_custkey",), nominal=("o_orderpriority",), log1p=("o_totalprice",))


def _orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders with a label and an age that is sometimes missing; one priority occurs only in late orders."""
    rows = tables.orders(spark, sf_dir).withColumn("label", (F.col("o_orderstatus") == "F").cast("int"))
    late = F.col("o_orderdate") >= F.lit("2001-01-01").cast("timestamp_ntz")
    return rows.withColumn("age", F.when(F.col("o_orderkey") % 11 > 0, (F.col("o_orderkey") % 101).cast("double"))).withColumn("o_orderpriority", F.when(late & (F.col("o_orderkey") % 5 == 0), "7-LATE").otherwise(F.col("o_orderpriority")))


def _train(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return split.split(_orders(spark, sf_dir), _SPLIT)


def chrono_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every order's side of a split at 80 % that divides no day."""
    rows = _orders(spark, sf_dir)
    return rows.select("o_orderkey", split.partition_column(F.col("t"), split.boundary_time(rows, "t", 0.2)).alias("partition"))


def split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _orders(spark, sf_dir)
    marked = rows.withColumn("partition", split.partition_column(F.col("t"), split.boundary_time(rows, "t", 0.2)))
    return split.partition_summary(marked, "partition", _SPLIT).withColumn("rate", F.round("rate", 6))


def _fitted(train: DataFrame, **more) -> preprocess.Preprocessor:
    """Fitted on the training rows; the shares of customers are a table where these are many."""
    return preprocess.fit(train, _CONFIG, share_path=new_path(train.sparkSession, "shares"), **more)


def numeric_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median, bounds, mean and scale of the training rows' numbers."""
    fitted = _fitted(_train(spark, sf_dir)[0])
    rows = [(c, *[round(s[k], 6) for k in ("median", "low", "high", "mean", "scale")]) for c, s in fitted.stats.items()]
    return spark.createDataFrame(rows, "feature string, median double, low double, high double, mean double, scale double")


def _dated(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, int]:
    """Development orders, the holdout of the last years, and where it starts."""
    rows = _orders(spark, sf_dir)
    at = split.boundary_time(rows, "t", 0.1)
    return rows.filter(F.col("t") < at), rows.filter(F.col("t") >= at), at


def manifest_partitions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows, labels, times and gap of a three-way split's manifest."""
    development, holdout, _ = _dated(spark, sf_dir)
    found = split.load_manifest(split.split_manifest(development, holdout, _SPLIT))
    rows = [(name, p["rows"], p["negatives"], p["positives"], p["first_time"], p["last_time"], found["gap_seconds"]) for name, p in found["partitions"].items()]
    return spark.createDataFrame(rows, "partition string, rows long, negatives long, positives long, first_time long, last_time long, gap_seconds long")


def bound_fit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statistics of numbers fitted on rows that were verified to be the training partition of the manifest."""
    development, holdout, _ = _dated(spark, sf_dir)
    manifest = split.split_manifest(development, holdout, _SPLIT)
    fitted = _fitted(split.split(development, _SPLIT)[0], by=_SPLIT, manifest=manifest)
    rows = [(c, fitted.context["rows"], fitted.context["first_time"], fitted.context["last_time"], fitted.context["positives"], *[round(s[k], 6) for k in ("median", "low", "high", "mean", "scale")]) for c, s in fitted.stats.items()]
    return spark.createDataFrame(rows, "feature string, rows long, first_time long, last_time long, positives long, median double, low double, high double, mean double, scale double")


def weighted_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Training rows with class weights, verified against the fitted state, by day."""
    train, _ = _train(spark, sf_dir)
    fitted = _fitted(train, by=_SPLIT)
    batch, record = imbalance.training_batch(train, "label", "o_orderkey", [], [], imbalance.ImbalanceConfig("class_weight"), fitted=fitted, by=_SPLIT)
    return batch.groupBy("label").agg(F.count("*").alias("rows"), F.round(F.max("weight"), 6).alias("weight"), F.lit(record["after"][1]).cast("long").alias("positives"))


def frequency_encoding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the training rows' customers, looked up for all rows."""
    fitted = _fitted(_train(spark, sf_dir)[0])
    out = fitted.transform(_orders(spark, sf_dir), ["o_orderkey"])
    return out.select("o_orderkey", F.round(F.col("freq__o_custkey").cast("double"), 6).alias("share"), F.col("freq__o_custkey__unknown").cast("int").alias("unknown"))


def vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    fitted = _fitted(_train(spark, sf_dir)[0])
    return spark.createDataFrame([(c, i, v) for c, levels in fitted.levels.items() for i, v in enumerate(levels)], "feature string, position long, level string")


def onehot_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The level that each validation row falls into."""
    train, rest = _train(spark, sf_dir)
    fitted = _fitted(train)
    names = [n for n in fitted.names() if n.startswith("cat__")]
    return preprocess.long_form(fitted.transform(rest, ["o_orderkey"]), "o_orderkey", names).filter("value = 1").select("o_orderkey", "feature")


def transform_long(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Standardised numbers of all rows with training statistics."""
    fitted = _fitted(_train(spark, sf_dir)[0])
    names = [n for n in fitted.names() if n.startswith("num__")]
    return preprocess.long_form(fitted.transform(_orders(spark, sf_dir), ["o_orderkey"]), "o_orderkey", names).withColumn("value", F.round("value", 3) + 0.0)


def cyclical_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = tables.events(spark, sf_dir)
    derived = preprocess.derived_columns(F.col("ts"), F.lit("1980-05-17").cast("date"))
    return rows.select("event_id", *[(F.round(c, 6) + 0.0).alias(n) for n, c in derived.items()])


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tables.events(spark, sf_dir).withColumn("label", ((F.col("event_type") == "error") & (F.col("event_id") % 3 == 0)).cast("int"))


def class_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _events(spark, sf_dir)
    weights = imbalance.class_weights(*imbalance.counts(rows, "label"))
    return rows.groupBy("label").agg(F.count("*").alias("rows"), F.round(F.max(imbalance.weight(F.col("label"), weights)), 6).alias("weight"))


def imbalance_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = imbalance.report(*imbalance.counts(_events(spark, sf_dir), "label"), imbalance.ImbalanceConfig(ratio=0.5))
    table = [(r["strategy"], r["negatives"], r["positives"], round(r["negative_weight"], 6), round(r["positive_weight"], 6)) for r in rows]
    return spark.createDataFrame(table, "strategy string, negatives long, positives long, negative_weight double, positive_weight double")


def random_under(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imbalance.random_under(_events(spark, sf_dir), "label", "event_id", imbalance.ImbalanceConfig("random_under", 0.5)).select("event_id", "label")


def negative_downsample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return imbalance.negative_sample(_events(spark, sf_dir), "label", "event_id", 3).select("event_id", "label")


def smotenc(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All events and synthetic positives, row by row."""
    rows = _events(spark, sf_dir).withColumn("k", F.get_json_object("props", "$.k").cast("double"))
    out = imbalance.smotenc(rows, "label", "event_id", ["value", "k"], ["event_type"], imbalance.ImbalanceConfig("smotenc", 0.5))
    return out.select("event_id", "label", "event_type", F.round("value", 6).alias("value"), F.round("k", 6).alias("k"))


QUERIES = {
    f.__name__: f
    for f in (
        chrono_split, split_summary, manifest_partitions, bound_fit, weighted_batch, numeric_stats, frequency_encoding, vocabulary, onehot_long, transform_long, cyclical_features,
        class_weights, imbalance_projection, random_under, negative_downsample, smotenc,
    )
}

_O = f"""(SELECT * REPLACE (CASE WHEN o_orderdate >= TIMESTAMP '2001-01-01' AND o_orderkey % 5 = 0 THEN '7-LATE' ELSE o_orderpriority END AS o_orderpriority), CAST(o_orderstatus = 'F' AS INTEGER) AS label,
  CASE WHEN o_orderkey % 11 > 0 THEN CAST(o_orderkey % 101 AS DOUBLE) END AS age FROM {tables.ORDERS})"""
_AT = f"(SELECT t FROM {tables.ORDERS} ORDER BY t LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM orders))"
_T = f"(SELECT * FROM {_O} WHERE t < {_AT})"
_STATS = f"""WITH t AS MATERIALIZED (SELECT o_totalprice, age FROM {_T}),
m AS (SELECT 'o_totalprice' AS feature, median(o_totalprice) AS median FROM t UNION ALL SELECT 'age', median(age) FROM t),
r AS (SELECT 'o_totalprice' AS feature, ln(1 + coalesce(o_totalprice, (SELECT median FROM m WHERE feature = 'o_totalprice'))) AS v FROM t UNION ALL SELECT 'age', coalesce(age, (SELECT median FROM m WHERE feature = 'age')) FROM t),
q AS (SELECT feature, quantile_cont(v, 0.005) AS low, quantile_cont(v, 0.995) AS high FROM r GROUP BY 1),
s AS (SELECT feature, m.median, low, high, avg(least(greatest(v, low), high)) AS mean, stddev_pop(least(greatest(v, low), high)) AS scale FROM r JOIN q USING (feature) JOIN m USING (feature) GROUP BY ALL)"""
_END = f"(SELECT t FROM {tables.ORDERS} ORDER BY t LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.9) AS BIGINT) FROM orders))"
_DEV = f"(SELECT * FROM {_O} WHERE t < {_END})"
_CUT = f"(SELECT t FROM {_DEV} ORDER BY t LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.8) AS BIGINT) FROM {_DEV}))"
_E = "(SELECT *, CAST(event_type = 'error' AND event_id % 3 = 0 AS INTEGER) AS label FROM events)"
_N = f"(SELECT sum(1 - label) AS neg, sum(label) AS pos FROM {_E})"
_ANGLE = lambda f, x, p: f"round({f}(2 * pi() / {p} * ({x})), 6) + 0.0"

SQL = {
    "chrono_split": f"SELECT o_orderkey, CASE WHEN t < {_AT} THEN 'train' ELSE 'validation' END AS partition FROM {tables.ORDERS}",
    "split_summary": f"SELECT CASE WHEN t < {_AT} THEN 'train' ELSE 'validation' END AS partition, count(*) AS rows, CAST(sum(1 - label) AS BIGINT) AS negatives, CAST(sum(label) AS BIGINT) AS positives, round(sum(label) / count(*), 6) AS rate, min(t) AS first_time, max(t) AS last_time FROM {_O} GROUP BY 1",
    "manifest_partitions": f"""WITH p AS (SELECT CASE WHEN t >= {_END} THEN 'holdout' WHEN t >= {_CUT} THEN 'validation' ELSE 'train' END AS partition, count(*) AS rows, CAST(sum(1 - label) AS BIGINT) AS negatives, CAST(sum(label) AS BIGINT) AS positives,
      min(t) AS first_time, max(t) AS last_time FROM {_O} GROUP BY 1)
      SELECT *, (SELECT first_time FROM p WHERE partition = 'holdout') - (SELECT last_time FROM p WHERE partition = 'validation') AS gap_seconds FROM p""",
    "bound_fit": _STATS.replace(_T, f"(SELECT * FROM {_DEV} WHERE t < {_CUT})") + f""", c AS (SELECT count(*) AS rows, min(t) AS first_time, max(t) AS last_time, CAST(sum(label) AS BIGINT) AS positives FROM {_DEV} WHERE t < {_CUT})
      SELECT feature, c.*, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean, round(scale, 6) AS scale FROM s, c""",
    "weighted_batch": f"SELECT label, count(*) AS rows, round((SELECT count(*) FROM {_T}) / (2 * count(*)), 6) AS weight, (SELECT CAST(sum(label) AS BIGINT) FROM {_T}) AS positives FROM {_T} GROUP BY 1",
    "numeric_stats": _STATS + " SELECT feature, round(median, 6) AS median, round(low, 6) AS low, round(high, 6) AS high, round(mean, 6) AS mean, round(scale, 6) AS scale FROM s",
    "frequency_encoding": f"SELECT o_orderkey, round(coalesce(CAST(CAST(s.share AS FLOAT) AS DOUBLE), 0.0), 6) AS share, CAST(s.share IS NULL AS INTEGER) AS unknown FROM orders LEFT JOIN (SELECT o_custkey, count(*) / (SELECT count(*) FROM {_T}) AS share FROM {_T} GROUP BY 1) s USING (o_custkey)",
    "vocabulary": f"SELECT 'o_orderpriority' AS feature, row_number() OVER (ORDER BY g, v) - 1 AS position, v AS level FROM (SELECT DISTINCT 0 AS g, o_orderpriority AS v FROM {_T} UNION ALL VALUES (1, '__MISSING__'), (2, '__UNKNOWN__'))",
    "onehot_long": f"SELECT o_orderkey, 'cat__o_orderpriority__' || CASE WHEN o_orderpriority IN (SELECT o_orderpriority FROM {_T}) THEN o_orderpriority ELSE '__UNKNOWN__' END AS feature FROM {_O} WHERE t >= {_AT}",
    "transform_long": _STATS
    + f""", a AS (SELECT o_orderkey, 'num__log1p_o_totalprice' AS name, 'o_totalprice' AS feature, ln(1 + o_totalprice) AS v FROM {_O} UNION ALL SELECT o_orderkey, 'num__age', 'age', coalesce(age, (SELECT median FROM m WHERE feature = 'age')) FROM {_O})
      SELECT o_orderkey, name AS feature, round(CAST(CAST((least(greatest(v, low), high) - mean) / scale AS FLOAT) AS DOUBLE), 3) + 0.0 AS value FROM a JOIN s USING (feature)""",
    "cyclical_features": f"""SELECT event_id, round(date_diff('day', DATE '1980-05-17', CAST(ts AS DATE)) / 365.2425, 6) AS age_years, {_ANGLE('sin', 'hour(ts)', 24)} AS hour_sin, {_ANGLE('cos', 'hour(ts)', 24)} AS hour_cos,
      {_ANGLE('sin', 'isodow(ts) - 1', 7)} AS day_sin, {_ANGLE('cos', 'isodow(ts) - 1', 7)} AS day_cos, {_ANGLE('sin', 'month(ts) - 1', 12)} AS month_sin, {_ANGLE('cos', 'month(ts) - 1', 12)} AS month_cos FROM events""",
    "class_weights": f"SELECT label, count(*) AS rows, round((SELECT neg + pos FROM {_N}) / (2 * count(*)), 6) AS weight FROM {_E} GROUP BY 1",
    "imbalance_projection": f"""SELECT strategy, CAST(n AS BIGINT) AS negatives, CAST(p AS BIGINT) AS positives, round(wn, 6) AS negative_weight, round(wp, 6) AS positive_weight FROM (
      SELECT 'none' AS strategy, neg AS n, pos AS p, 1.0::DOUBLE AS wn, 1.0::DOUBLE AS wp FROM {_N} UNION ALL SELECT 'class_weight', neg, pos, (neg + pos) / (2 * neg), (neg + pos) / (2 * pos) FROM {_N}
      UNION ALL SELECT 'random_under', floor(pos / 0.5), pos, 1.0, 1.0 FROM {_N} UNION ALL SELECT 'smotenc', neg, floor(neg * 0.5), 1.0, 1.0 FROM {_N})""",
    "random_under": f"SELECT event_id, label FROM {_E} QUALIFY label = 1 OR row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id), event_id) <= (SELECT floor(pos / 0.5) FROM {_N})",
    "negative_downsample": f"SELECT event_id, label FROM {_E} QUALIFY label = 1 OR row_number() OVER (PARTITION BY label ORDER BY md5('42:' || event_id), event_id) <= (SELECT 3 * pos FROM {_N})",
}
