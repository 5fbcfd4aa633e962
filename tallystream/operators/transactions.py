"""Card transactions end to end: features, preparation, profile, model tables, scoring and a drift simulation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tallystream.functions.scalars import causal_seconds, coordinates_valid, event_seconds, haversine_km, row_key
from tallystream.operators import checks, drift, fusion, profile
from tallystream.operators.preprocess import PreprocessConfig, Preprocessor, derived_columns, fit
from tallystream.operators.sequences import add_pointer
from tallystream.operators.split import SplitConfig, boundary_time, load_manifest, partition_column
from tallystream.operators.velocity import VelocityConfig, add_velocity, check_amounts
from tallystream.streaming.activity import velocity_from_snapshot

#: The columns of the model matrix by role.
NUMERIC = (
    "amt", "city_pop", "distance_card_merchant_km", "cc_txn_count_prev_1h", "cc_amt_sum_prev_1h", "cc_txn_count_prev_6h", "cc_amt_sum_prev_6h",
    "cc_txn_count_prev_24h", "cc_amt_sum_prev_24h", "cc_txn_count_prior", "cc_amt_sum_prior",
)
DERIVED = ("age_years", "hour_sin", "hour_cos", "day_sin", "day_cos", "month_sin", "month_cos")
NOMINAL = ("category", "state")
FREQUENCY = ("merchant", "city", "job", "zip")
CONFIG = PreprocessConfig(numeric=NUMERIC + DERIVED, frequency=FREQUENCY, nominal=NOMINAL, log1p=NUMERIC)


def add_distance(df: DataFrame, *, invalid: str = "raise") -> DataFrame:
    """Add the distance between card holder and merchant; invalid places are an error, or give NaN."""
    places = [F.col(c) for c in ("lat", "long", "merch_lat", "merch_long")]
    valid = coordinates_valid(*places[:2]) & coordinates_valid(*places[2:])
    if invalid == "raise":
        checks.enforce(df, {"coordinates": valid})
    elif invalid != "nan":
        raise ValueError("invalid places are raised or made NaN")
    return df.withColumn("distance_card_merchant_km", F.when(valid, haversine_km(*places)).otherwise(float("nan")))


def engineer_features(df: DataFrame, config: VelocityConfig = VelocityConfig(), *, invalid: str = "raise", heavy: bool = False, chunk: int | None = None) -> DataFrame:
    """Distance and causal activity; ``heavy`` and ``chunk`` as in ``add_velocity``."""
    check_amounts(df, config.amount)
    return add_velocity(add_distance(df, invalid=invalid), config, heavy=heavy, chunk=chunk)


def prepare(df: DataFrame) -> DataFrame:
    """Add age and calendar columns; malformed times and dates, and births after the transaction, are an error."""
    at, born = F.try_to_timestamp(F.col("trans_date_trans_time"), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.col("dob"), F.lit("yyyy-MM-dd")).cast("date")
    checks.enforce(df, {"trans_date_trans_time": at.isNotNull(), "dob": born.isNotNull() & (born <= at.cast("date")), "amt": F.col("amt") > 0})
    return df.withColumns(derived_columns(at, born))


def transaction_profile(df: DataFrame, *, sample: int = 50_000, positives: int = 20_000, seed: int = 42) -> dict[str, DataFrame]:
    """The tables of a profile: summary, missing values, quality checks, counts by label, and samples without personal data."""
    at = F.to_timestamp("trans_date_trans_time")
    out = {"summary": profile.summary(df, "is_fraud", "amt", ["cc_num", "merchant", "category", "state"]), "missing": profile.missing(df)}
    for name, key in profile.calendar_keys(at).items():
        out[name] = profile.label_counts(df, "is_fraud", **{name: key})
    out["state"] = profile.label_counts(df, "is_fraud", state=F.col("state"))
    out["geo"] = profile.label_counts(df, "is_fraud", **profile.geo_cell(F.col("merch_lat"), F.col("merch_long")))
    place = coordinates_valid(F.col("lat"), F.col("long")) & coordinates_valid(F.col("merch_lat"), F.col("merch_long"))
    rules = {"amount": F.col("amt") <= 0, "coordinates": ~place, "label": ~F.col("is_fraud").isin(0, 1), "display_time": at.isNull(), "key": F.col("trans_num").isNull()}
    out["quality"] = profile.quality_checks(df, rules)
    out["backsteps"] = checks.backsteps(df.withColumn("display", F.unix_timestamp(at)), ["unix_time", "display"], "row_idx")
    out["label_sample"] = profile.without_personal(profile.stratified_bottom_k(df, "trans_num", "is_fraud", {1: positives, 0: sample}, seed))
    out["sample"] = profile.without_personal(profile.bottom_k(df, "trans_num", sample, seed))
    return out


def model_table(development: DataFrame, holdout: DataFrame, config: PreprocessConfig = CONFIG, by: SplitConfig = SplitConfig(), *, manifest: dict | None = None) -> tuple[DataFrame, Preprocessor]:
    """One matrix with a column ``partition`` (train, validation, holdout) and pointers, and the fitted preprocessor.

    Features of the holdout go on from the development rows: both are one stream. With the sealed manifest of the split the
    training rows must be its own, and the matrix must have as many rows and labels in each partition as it says.
    """
    at = boundary_time(development, by.time, by.fraction)
    start = development.agg(F.max("row_idx") + 1).first()[0] or 0
    both = development.withColumn("partition", partition_column(F.col(by.time), at)).unionByName(holdout.withColumn("partition", F.lit("holdout")).withColumn("row_idx", F.col("row_idx") + start))
    rows = add_pointer(prepare(engineer_features(both)))
    fitted = fit(rows.filter("partition = 'train'"), config, by=by, manifest=manifest)
    matrix = fitted.transform(rows, ["row_idx", by.key, "partition", F.col(by.label).alias("label"), "previous"])
    if manifest is not None:
        check_counts(partition_counts(matrix), manifest)
    return matrix, fitted


def check_counts(counts: DataFrame, manifest: dict) -> None:
    """Raise unless rows and labels of each partition are those of the manifest."""
    own = {(r["partition"], r["label"]): r["rows"] for r in counts.collect()}  # two rows per partition
    wanted = {(name, v): part[k] for name, part in load_manifest(manifest)["partitions"].items() for v, k in ((0, "negatives"), (1, "positives")) if part[k]}
    if own != wanted:
        raise ValueError("partitions of the matrix differ from the manifest")


def partition_counts(matrix: DataFrame) -> DataFrame:
    return matrix.groupBy("partition", "label").agg(F.count("*").alias("rows"), F.count_if(F.col("previous") == -1).alias("cold"))


#: What a submitted transaction must have, and what it may have.
REQUIRED = ("trans_date_trans_time", "cc_num", "merchant", "category", "amt", "city", "state", "zip", "lat", "long", "city_pop", "job", "dob", "merch_lat", "merch_long")
TEXT, POSITIVE, NOT_NEGATIVE = ("cc_num", "merchant", "category", "city", "state", "zip", "job"), ("amt",), ("city_pop",)
MAX_BATCH = 10_000


def normalize_batch(df: DataFrame, *, max_rows: int = MAX_BATCH) -> DataFrame:
    """Submitted transactions, checked, trimmed and typed; the whole batch is rejected where a row breaks a rule.

    Times, birth dates (not after the transaction), finite numbers, amounts above 0 and populations of at least 0 are required.
    A missing causal clock is derived from the display time, a missing key from the row's content and its place (``row_idx``, or
    the order of the content where there is none). Keys must not repeat in a batch.
    """
    numeric = [c for c in REQUIRED if c in ("amt", "lat", "long", "city_pop", "merch_lat", "merch_long")]
    optional = [c for c in ("trans_num", "unix_time", "row_idx") if c in df.columns]
    rows = checks.normalize_transactions(df, [*REQUIRED, *optional], text=list(TEXT), numeric=numeric, positive=list(POSITIVE), max_rows=max_rows)
    at, born = F.try_to_timestamp(F.col("trans_date_trans_time"), F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(F.col("dob"), F.lit("yyyy-MM-dd")).cast("date")
    given = F.col("unix_time") if "unix_time" in optional else F.lit(None).cast("string")
    rules = {"trans_date_trans_time": at.isNotNull(), "dob": born.isNotNull() & (born <= at.cast("date")), "unix_time": given.isNull() | event_seconds(given).isNotNull()}
    if not checks.enforce(rows, rules | {c: F.col(c) >= 0 for c in NOT_NEGATIVE}):
        raise ValueError("an empty batch: submit at least one row")
    rows = rows.withColumn("unix_time", F.coalesce(event_seconds(given), causal_seconds(at)))
    rows = rows.withColumns({"trans_date_trans_time": F.date_format(at, "yyyy-MM-dd HH:mm:ss"), "dob": F.date_format(born, "yyyy-MM-dd")})
    content = [*REQUIRED, "unix_time"]
    place = F.col("row_idx") if "row_idx" in optional else F.row_number().over(Window.orderBy(*content))  # a bounded batch
    key = F.trim(F.col("trans_num").cast("string")) if "trans_num" in optional else F.lit(None).cast("string")
    rows = rows.withColumn("trans_num", F.when(F.length(key) > 0, key).otherwise(row_key(content, place)))
    if checks.duplicate_keys(rows, "trans_num").limit(1).count():
        raise ValueError("trans_num must not repeat within a batch")
    return rows


def batch_template(spark: SparkSession) -> DataFrame:
    """One made-up row with the columns of a submitted batch: a form to fill in, written as CSV. Its clock may stay empty."""
    numbers = {"amt": 12.5, "lat": 40.0, "long": -75.0, "city_pop": 25000, "merch_lat": 40.1, "merch_long": -75.2}
    texts = {"trans_date_trans_time": "2020-06-01 12:30:00", "cc_num": "4000000000000002", "zip": "00501", "dob": "1980-01-31", "trans_num": "row-1", "unix_time": ""}
    row = {c: numbers.get(c, texts.get(c, f"a {c}")) for c in (*REQUIRED, "trans_num", "unix_time")}
    kinds = ", ".join(f"{c} {'long' if c == 'city_pop' else 'double' if c in numbers else 'string'}" for c in row)
    return spark.createDataFrame([tuple(row.values())], kinds)


def score_batch(df: DataFrame, snapshot: DataFrame, fitted: Preprocessor, scorers: dict, hybrid: fusion.Hybrid, *, keep: list[str], explain=None) -> DataFrame:
    """Prepared features of new rows from a snapshot of the past, component scores, their blend, the decision and drivers.

    ``scorers`` maps a score's name to a function that adds it to the prepared rows; ``explain`` gives the drivers' column.
    """
    rows = fitted.transform(prepare(velocity_from_snapshot(add_distance(df), snapshot, VelocityConfig())), keep)
    for add in scorers.values():
        rows = add(rows)
    rows = hybrid.score(rows)
    return rows.withColumn("drivers", explain) if explain is not None else rows


def drift_simulation(reference: DataFrame, holdout: DataFrame, features: list[str], key: str, p: str = "p", config: drift.DriftConfig = drift.DriftConfig()) -> dict[str, dict]:
    """Drift of features and scores in three windows: the reference itself, the holdout, and one with an injected shift."""
    detector = drift.DriftDetector.fit(reference, features, key, config)
    windows = {"reference": reference, "holdout": holdout, "injected": drift.injected_shift(holdout, features[:4], detector.stats, p)}
    out = {}
    for name, rows in windows.items():
        found = detector.evaluate(rows, key)
        out[name] = {"features": drift.drift_summary(found).first().asDict(), "top": [r.asDict() for r in drift.top_drift(found, config.top).collect()], "scores": drift.score_drift(reference, rows, p, config)}
    return out
