"""Tables that are written, verified and read again, and what hangs on rows and keys."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.functions import scalars
from tallystream.operators import checks, drift, fusion, profile, sequences, split, transactions
from tallystream.plans import activity, preparing, quality, tables
from tallystream.plans import learning
from tallystream.sources import artifacts, ledger
from tallystream.sources import tables as files
from tallystream.sources.shared import new_path
from tallystream.streaming.activity import load_snapshot, save_snapshot, state_snapshot


def csv_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders written as compressed CSV and read again by their schema, with rules that ride on the write and on the read."""
    rows = tables.orders(spark, sf_dir).select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "t")
    path = new_path(spark, "orders-csv")
    rules = {"key": F.col("o_orderkey").isNotNull(), "price": F.col("o_totalprice") > 0, "time": F.col("t") >= 0}
    files.write_csv(rows, path, gzip=True, rules=rules)
    return files.ingest_csv(spark, path, rows.schema, rules)


def partition_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table in a folder per partition, read again and verified against its record."""
    rows = preparing.chrono_split(spark, sf_dir)
    path = new_path(spark, "partitions")
    files.write_partitions(rows, path)
    return artifacts.verified_table(spark.read.schema(rows.schema).parquet(path), artifacts.table_record(rows)).filter("partition = 'validation'")


def head_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first thousand orders by a filter on their number."""
    return files.head_by_index(tables.orders(spark, sf_dir), 1000, "o_orderkey").select("o_orderkey", "o_totalprice")


def chained_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Early and late orders one after another, numbered through."""
    rows = tables.orders(spark, sf_dir).select(F.col("o_orderkey").alias("row_idx"), "t")
    at = split.boundary_time(rows, "t", 0.5)
    return files.chained(rows.filter(F.col("t") < at), rows.filter(F.col("t") >= at), time="t")


def ledger_versions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reviews of scored orders in two versions of a ledger: the label of the second, all else of the first."""
    rows = quality.scored(spark, sf_dir)
    text = {c: F.lit("{}") for c in ledger.LEDGER_COLUMNS if c.endswith(("json", "sha256"))}
    review = rows.select(F.col("o_orderkey").cast("string").alias("prediction_id"), F.lit("2024-01-01").alias("created_at_utc"), F.lit("2024-01-01").alias("updated_at_utc"), F.lit("false_positive").alias("reviewer_label"), F.col("p").alias("fraud_probability"), F.lit(0.5).alias("decision_threshold"), F.lit(1).alias("fraud_flag"), *[v.alias(k) for k, v in text.items()], F.lit(1).alias("context_depth"))
    later = review.filter(F.col("prediction_id").cast("long") % 2 == 0).withColumns({"updated_at_utc": F.lit("2024-02-02"), "reviewer_label": F.lit("confirm_fraud"), "fraud_probability": F.lit(0.0)})
    folder = new_path(spark, "ledger")
    ledger.store(spark, folder, review)
    version = ledger.store(spark, folder, later)
    return spark.read.parquet(f"{folder}/v{version:08d}").select("prediction_id", "created_at_utc", "updated_at_utc", "reviewer_label", F.round("fraud_probability", 6).alias("p"))


def gathered_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices of the last four orders, gathered from a matrix by the row numbers of the histories."""
    rows = tables.orders(spark, sf_dir)
    histories = sequences.add_history(rows, 4, **activity._ORDER).select("o_orderkey", "history")
    out = sequences.gather_history(histories, rows, ["o_totalprice", "o_custkey"], row="o_orderkey")
    padded = sequences.pad_history(F.transform("sequence", lambda v: v[0]), 4, F.lit(0.0))
    return out.select("o_orderkey", *[padded[i].alias(f"v{i}") for i in range(4)])


def sampler_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of the matrix, and those that its sampler frame gives otherwise."""
    fitted = preparing._fitted(preparing._train(spark, sf_dir)[0])
    rows = preparing._orders(spark, sf_dir)
    direct, back = fitted.transform(rows, ["o_orderkey"]), fitted.from_sampler_frame(fitted.sampler_frame(rows, ["o_orderkey"]), ["o_orderkey"])
    return direct.agg(F.count("*").alias("rows")).crossJoin(direct.exceptAll(back).agg(F.count("*").alias("different")))  # one row each


def causal_clock(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The causal clock of orders, their share of the customer's prior spending, and masked customers."""
    rows = tables.orders(spark, sf_dir)
    return rows.select("o_orderkey", scalars.causal_seconds(F.col("o_orderdate")).alias("clock"), F.round(scalars.safe_ratio(F.col("o_totalprice"), (F.col("o_orderkey") % 3).cast("double")), 6).alias("ratio"), scalars.mask_tail(F.lpad(F.col("o_custkey").cast("string"), 8, "0")).alias("customer"))


def row_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Keys derived from the content and place of rows."""
    rows = tables.orders(spark, sf_dir)
    return rows.select("o_orderkey", scalars.row_key(["o_orderkey", "o_custkey"], F.col("o_orderkey")).alias("key"))


def top_drift(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two features that drift most."""
    return drift.top_drift(quality.psi_features(spark, sf_dir), 2).select("feature", "psi")


def saved_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The state after all events, saved, verified and loaded."""
    config = learning._CONFIG
    path = new_path(spark, "activity-state")
    save_snapshot(state_snapshot(learning.some_unknown(spark, sf_dir), config), config, path)
    return load_snapshot(spark, path, config).select("entity", "open", "open_n", "open_cents", "total_n", "total_cents", F.size("times").cast("long").alias("buckets"))


def index_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows whose export index is not their number; the index itself is dropped from the table."""
    rows = tables.orders(spark, sf_dir).select("o_orderkey", F.col("o_orderkey").alias("Unnamed: 0"), F.when(F.col("o_orderkey") % 10 > 0, F.col("o_orderkey")).alias("index"))
    kept = checks.drop_export_index(rows)
    return checks.index_mismatches(kept, "index", "o_orderkey").withColumn("columns", F.lit(",".join(kept.columns)))


def missing_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Columns with missing values."""
    rows = preparing._orders(spark, sf_dir).select("o_orderkey", "age", F.when(F.col("o_custkey") % 5 > 0, 1).alias("flag"))
    return profile.missing(rows, only=True).select("column", "missing", F.round("share", 6).alias("share"))


def predictions_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scored orders found again by the digest of their keys."""
    rows = fusion.with_ids(quality.scored(spark, sf_dir).withColumn("hybrid_probability", F.col("p")), "o_orderkey", {"sha256": "A"})
    ids = [r["prediction_id"] for r in rows.filter(F.col("o_orderkey").isin(1, 7, 100)).select("prediction_id").collect()]
    return fusion.by_id(rows, ids).select("o_orderkey", "prediction_id", F.round("p", 6).alias("p"))


def distances(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Distances between made-up places of orders, NaN where a place is none; and null where that is asked for."""
    k = F.col("o_orderkey")
    rows = tables.orders(spark, sf_dir).select("o_orderkey", (k % 190 - 95).cast("double").alias("lat"), (k % 360 - 180).cast("double").alias("long"), (k % 90).cast("double").alias("merch_lat"), (k % 179).cast("double").alias("merch_long"))
    out = transactions.add_distance(rows, invalid="nan")
    places = [F.col(c) for c in ("lat", "long", "merch_lat", "merch_long")]
    known = checks.distance_or_null(*places, F.col("distance_card_merchant_km"))
    return out.select("o_orderkey", F.round(known, 4).alias("km"), F.isnan("distance_card_merchant_km").alias("unknown"))


QUERIES = {
    f.__name__: f
    for f in (
        csv_roundtrip, partition_roundtrip, head_rows, chained_rows, ledger_versions, gathered_history, sampler_roundtrip, causal_clock, row_keys, top_drift, saved_state, index_checks,
        missing_only, predictions_by_id, distances,
    )
}

SQL = {
    "csv_roundtrip": f"SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, t FROM {tables.ORDERS}",
    "partition_roundtrip": f"SELECT * FROM ({preparing.SQL['chrono_split']}) WHERE partition = 'validation'",
    "head_rows": "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderkey < 1000",
    "chained_rows": f"""WITH o AS (SELECT o_orderkey AS k, t FROM {tables.ORDERS}), a AS (SELECT t FROM o ORDER BY t LIMIT 1 OFFSET (SELECT CAST(floor(count(*) * 0.5) AS BIGINT) FROM o))
      SELECT CASE WHEN t < (SELECT t FROM a) THEN k ELSE k + 1 + (SELECT max(k) FROM o WHERE t < (SELECT t FROM a)) END AS row_idx, t FROM o""",
    "ledger_versions": f"SELECT CAST(o_orderkey AS VARCHAR) AS prediction_id, '2024-01-01' AS created_at_utc, CASE WHEN o_orderkey % 2 = 0 THEN '2024-02-02' ELSE '2024-01-01' END AS updated_at_utc, CASE WHEN o_orderkey % 2 = 0 THEN 'confirm_fraud' ELSE 'false_positive' END AS reviewer_label, round(p, 6) AS p FROM {quality._S}",
    "gathered_history": activity.SQL["sequence_values_padded"],
    "sampler_roundtrip": "SELECT count(*) AS rows, CAST(0 AS BIGINT) AS different FROM orders",
    "causal_clock": f"SELECT o_orderkey, t - 220924800 AS clock, round(coalesce(o_totalprice / nullif(o_orderkey % 3, 0), 0.0), 6) AS ratio, '••••' || right(lpad(CAST(o_custkey AS VARCHAR), 8, '0'), 4) AS customer FROM {tables.ORDERS}",
    "row_keys": """SELECT o_orderkey, sha256('{"o_custkey":' || o_custkey || ',"o_orderkey":' || o_orderkey || ',"position":' || o_orderkey || '}') AS key FROM orders""",
    "top_drift": f"SELECT feature, psi FROM ({quality.SQL['psi_features']}) ORDER BY psi DESC, feature LIMIT 2",
    "saved_state": learning.SQL["advanced_state"],
    "index_checks": "SELECT count(*) FILTER (WHERE o_orderkey % 10 = 0) AS mismatches, 'o_orderkey,index' AS columns FROM orders",
    "missing_only": "SELECT 'age' AS column, count(*) FILTER (WHERE o_orderkey % 11 = 0) AS missing, round(count(*) FILTER (WHERE o_orderkey % 11 = 0) / count(*), 6) AS share FROM orders UNION ALL SELECT 'flag', count(*) FILTER (WHERE o_custkey % 5 = 0), round(count(*) FILTER (WHERE o_custkey % 5 = 0) / count(*), 6) FROM orders",
    "predictions_by_id": f"SELECT o_orderkey, sha256('A:' || o_orderkey) AS prediction_id, round(p, 6) AS p FROM {quality._S} WHERE o_orderkey IN (1, 7, 100)",
    "distances": """WITH p AS (SELECT o_orderkey, CAST(o_orderkey % 190 - 95 AS DOUBLE) AS a, CAST(o_orderkey % 360 - 180 AS DOUBLE) AS b, CAST(o_orderkey % 90 AS DOUBLE) AS c, CAST(o_orderkey % 179 AS DOUBLE) AS d FROM orders),
      h AS (SELECT *, least(greatest(pow(sin(radians(c - a) / 2), 2) + cos(radians(a)) * cos(radians(c)) * pow(sin(radians(d - b) / 2), 2), 0.0), 1.0) AS x FROM p)
      SELECT o_orderkey, CASE WHEN abs(a) <= 90 THEN round(2 * 6371.0088 * atan2(sqrt(x), sqrt(1 - x)), 4) END AS km, abs(a) > 90 AS unknown FROM h""",
}
