"""Review ledger: one row per prediction, merged by key.

A first review fixes what was predicted; later ones change the label and its time only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators.checks import enforce

#: What a reviewer may say, and the ledger's columns.
LABELS = ("confirm_fraud", "false_positive")
LEDGER_COLUMNS = [
    "prediction_id", "created_at_utc", "updated_at_utc", "reviewer_label", "fraud_probability", "decision_threshold", "fraud_flag",
    "model_config_sha256", "transaction_json", "engineered_features_json", "component_probabilities_json", "context_depth",
]
FIXED = LEDGER_COLUMNS[4:]
#: Rows of an export at most.
EXPORT_LIMIT = 100_000


def ledger_rules(labels: tuple[str, ...] = LABELS) -> dict[str, Column]:
    chance = lambda c: F.col(c).between(0, 1) & ~F.isnan(c)
    return {
        "prediction_id": F.length(F.trim("prediction_id")) > 0, "reviewer_label": F.col("reviewer_label").isin(*labels),
        "fraud_probability": chance("fraud_probability"), "decision_threshold": chance("decision_threshold"), "fraud_flag": F.col("fraud_flag").isin(0, 1), "context_depth": F.col("context_depth") >= 1,
    }


def merge(ledger: DataFrame, reviews: DataFrame, *, key: str = "prediction_id", at: str = "updated_at_utc", created: str = "created_at_utc", label: str = "reviewer_label", fixed: list[str] = FIXED, order: list[str] | None = None) -> DataFrame:
    """The ledger after the reviews: first creation and first fixed columns, last label. One shuffle, no gathered groups. Of reviews
    that are first at the same time the first by the columns ``order`` of both tables, if any, counts, then the one of the smallest
    fixed columns, all of these from one review."""
    rows = ledger.unionByName(reviews.withColumn(created, F.col(at)) if created not in reviews.columns else reviews)
    first = [F.min_by(F.col(c), F.struct(F.col(created), F.col(at), *[F.col(x) for x in [*(order or []), *fixed]])).alias(c) for c in fixed]
    return rows.groupBy(key).agg(F.min(created).alias(created), F.max(at).alias(at), *first, F.max_by(F.col(label), F.struct(F.col(at), F.col(label))).alias(label))


def record(ledger: DataFrame, reviews: DataFrame) -> DataFrame:
    """``merge`` after the reviews were checked."""
    enforce(reviews, ledger_rules())
    return merge(ledger, reviews).select(*LEDGER_COLUMNS)


def store(spark: SparkSession, folder: str, reviews: DataFrame) -> int:
    """Merge reviews into the ledger below ``folder`` and return its new version.

    Every version is a table of its own, written once: of two writers that start from one version the second fails, and its
    reviews are not lost in silence.
    """
    version = latest_version(spark, folder)
    before = spark.read.parquet(f"{folder}/v{version:08d}") if version else reviews.limit(0).select(*LEDGER_COLUMNS)
    record(before, reviews).write.mode("errorifexists").parquet(f"{folder}/v{version + 1:08d}")
    return version + 1


def latest_version(spark: SparkSession, folder: str) -> int:
    """The number of the last version that was written whole; 0 where there is none."""
    path = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/v*/_SUCCESS")
    found = path.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(path)
    return max((int(f.getPath().getParent().getName()[1:]) for f in found or []), default=0)


def export_csv(ledger: DataFrame, path: str, *, limit: int = EXPORT_LIMIT, overwrite: bool = False) -> int:
    """The newest reviews as one CSV file with a header, in a folder; an empty ledger gives a folder without a file. Returns the
    rows."""
    rows = newest(ledger, limit).select(*LEDGER_COLUMNS)
    n = rows.count()
    rows.coalesce(1).write.mode("overwrite" if overwrite else "errorifexists").options(header=True, lineSep="\n", emptyValue="", escape='"').csv(path)
    return n


def newest(ledger: DataFrame, limit: int, *, key: str = "prediction_id", at: str = "updated_at_utc") -> DataFrame:
    if limit < 1:
        raise ValueError("the limit must be positive")
    return ledger.orderBy(F.desc(at), F.desc(key)).limit(limit)
