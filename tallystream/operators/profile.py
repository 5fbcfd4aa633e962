"""Profiling: grouped counts, summaries, missing values, quality checks, correlations and deterministic samples."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.ranges import cuts_by, range_of


def label_counts(df: DataFrame, label: str, **keys: Column) -> DataFrame:
    """Rows by key and label, nulls included."""
    return df.groupBy(*[c.alias(name) for name, c in keys.items()], F.col(label).alias("label")).agg(F.count("*").alias("rows"))


def calendar_keys(ts: Column) -> dict[str, Column]:
    """Hour, weekday (Monday is 0) and the Monday of the week."""
    return {"hour": F.hour(ts), "weekday": F.weekday(ts), "week": F.date_trunc("week", ts).cast("date")}


def geo_cell(lat: Column, lon: Column) -> dict[str, Column]:
    """Centres of one-degree cells."""
    return {"lat_bin": F.floor(lat) + 0.5, "lon_bin": F.floor(lon) + 0.5}


def summary(df: DataFrame, label: str, amount: str, distinct: list[str] = ()) -> DataFrame:
    """One row: counts, rate, ratio of negatives to positives (infinite without positives), amounts, exact distinct counts."""
    bad, good = F.count_if(F.col(label) == 1), F.count_if(F.col(label) == 0)
    return df.agg(
        F.count("*").alias("rows"), bad.alias("positives"), good.alias("negatives"), (bad / F.count("*")).alias("rate"),
        F.when(bad == 0, F.lit(float("inf"))).otherwise(F.try_divide(good, bad)).alias("ratio"),
        F.sum(F.rint(F.col(amount) * 100).cast("long")).alias("cents"), F.min(amount).alias("least"), F.max(amount).alias("most"),
        *[F.count_distinct(F.col(c)).alias(f"distinct_{c}") for c in distinct],
    )


def missing(df: DataFrame, *, only: bool = False) -> DataFrame:
    """One row per column: nulls and their share; with ``only``, the columns that have nulls."""
    counts = df.agg(F.count("*").alias("__n"), *[F.count_if(F.col(c).isNull()).alias(c) for c in df.columns])
    entries = F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("missing")) for c in df.columns])
    out = counts.select("__n", F.inline(entries)).select("column", "missing", F.coalesce(F.try_divide("missing", "__n"), F.lit(0.0)).alias("share"))
    return out.filter("missing > 0") if only else out


def quality_checks(df: DataFrame, rules: dict[str, Column], known: dict[str, int] | None = None) -> DataFrame:
    """One row per rule: rows that break it, and PASS, KNOWN_DATASET_ARTIFACT (exactly the known number) or REVIEW."""
    known = known or {}
    counts = df.agg(*[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in rules.items()])
    rows = F.array(*[F.struct(F.lit(n).alias("check"), F.col(n).alias("found"), F.lit(known.get(n)).cast("long").alias("expected")) for n in rules])
    status = F.when(F.col("found") == 0, "PASS").when(F.col("found") == F.col("expected"), "KNOWN_DATASET_ARTIFACT").otherwise("REVIEW")
    return counts.select(F.inline(rows)).select("check", "found", status.alias("status"))


def label_pivot(df: DataFrame, key: str, label: str, least: int = 0) -> DataFrame:
    """Per key: negatives, positives, total and rate; keys of at least ``least`` rows."""
    counts = df.groupBy(key).agg(F.count_if(F.col(label) == 0).alias("negatives"), F.count_if(F.col(label) == 1).alias("positives"))
    out = counts.withColumn("total", F.col("negatives") + F.col("positives")).withColumn("rate", F.coalesce(F.try_divide("positives", "total"), F.lit(0.0)))
    return out.filter(F.col("total") >= least)


def share_within_label(df: DataFrame, key: str, label: str) -> DataFrame:
    """Each key's share of the rows of its label."""
    counts = df.groupBy(key, label).agg(F.count("*").alias("rows"))
    return counts.withColumn("share", F.col("rows") / F.sum("rows").over(Window.partitionBy(label)))


def pearson(df: DataFrame, columns: list[str]) -> DataFrame:
    """Correlation of every pair of columns, over rows without a null in the pair, in one aggregation."""
    pairs = list(combinations(columns, 2))
    both = lambda a, b, c: F.when(F.col(a).isNotNull() & F.col(b).isNotNull(), F.col(c).cast("double"))
    row = df.agg(*[F.corr(both(a, b, a), both(a, b, b)).alias(f"p{i}") for i, (a, b) in enumerate(pairs)])
    return row.select(F.inline(F.array(*[F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"p{i}").alias("r")) for i, (a, b) in enumerate(pairs)])))


def average_ranks(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """Ranks of each column, ties averaged. Distinct values are ranked, not rows, in ranges of values, so no task sees all."""
    at = F.coalesce(*[F.when(F.col("column") == c, range_of(F.col("value"), found)) for c, found in cuts_by(df, columns).items()])
    long = df.select(row, F.inline(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("double").alias("value")) for c in columns]))).filter("value is not null")
    counts = long.groupBy("column", "value").agg(F.count("*").alias("n")).withColumn("__p", at)
    inside = counts.withColumn("__upto", F.sum("n").over(Window.partitionBy("column", "__p").orderBy("value")))
    totals = counts.groupBy("column", "__p").agg(F.sum("n").alias("t"))
    before = totals.withColumn("before", F.sum("t").over(Window.partitionBy("column").orderBy("__p")) - F.col("t")).select("column", "__p", "before")
    ranked = inside.join(F.broadcast(before), ["column", "__p"]).select("column", "value", (F.col("before") + F.col("__upto") - (F.col("n") - 1) / 2).alias("rank"))
    return long.join(ranked, ["column", "value"]).groupBy(row).pivot("column", columns).agg(F.first("rank"))


def spearman(df: DataFrame, columns: list[str], row: str) -> DataFrame:
    """Pearson correlation of average ranks, over all rows."""
    return pearson(average_ranks(df, columns, row), columns)


def sample_order(key: Column, seed: int) -> Column:
    """A fixed pseudo-random order of keys."""
    return F.md5(F.concat(F.lit(f"{seed}:"), key.cast("string")).cast("binary"))


#: Rows of a sample up to which it is a top-k; larger ones are cut off at a threshold. Hexadecimal digits of a step to it.
TOP_ROWS, DIGITS = 100_000, 4


def bottom_k(df: DataFrame, key: str, k: int, seed: int = 42, *, top_rows: int = TOP_ROWS) -> DataFrame:
    """``k`` rows of the smallest hash of the key: a uniform sample that does not depend on the order or partition of rows.

    A small sample is a top-k, in the order of the hashes. A larger one would end in one task; its last hash is found first, by
    counts of its leading digits, and rows up to there are filtered, in no order.
    """
    if k <= top_rows:
        return df.orderBy(sample_order(F.col(key), seed), key).limit(k)
    order = sample_order(F.col(key), seed)
    prefix, left, rows = "", k, df.select(order.alias("h"), F.col(key).alias("k"))
    while len(prefix) < 32:
        inside = F.substring("h", len(prefix) + 1, DIGITS)
        for r in rows.groupBy(inside.alias("d")).agg(F.count("*").alias("n")).orderBy("d").collect():  # 16 ** DIGITS rows at most
            if left <= r["n"]:
                break
            left -= r["n"]
        else:
            return df
        prefix, rows = prefix + r["d"], rows.filter(inside == r["d"])
        if r["n"] <= top_rows:
            break
    last = rows.orderBy("h", "k").limit(left).agg(F.max(F.struct("h", "k")).alias("last")).first()["last"]
    own, end = F.struct(order.alias("h"), F.col(key).alias("k")), F.struct(F.lit(last["h"]).alias("h"), F.lit(last["k"]).cast(df.schema[key].dataType).alias("k"))
    # Rows that repeat the last key count one by one.
    same = left - rows.filter(F.struct("h", "k") < end).count()
    return df.filter(own < end).unionByName(df.filter(own == end).limit(same))


def stratified_bottom_k(df: DataFrame, key: str, stratum: str, sizes: dict, seed: int = 42) -> DataFrame:
    """As many rows of the smallest hash from each stratum as ``sizes`` says: one top-k per stratum."""
    parts = [bottom_k(df.filter(F.col(stratum) == value), key, k, seed) for value, k in sizes.items()]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


#: Columns that may leave in samples: no names, streets, cities or identifiers.
SAMPLE_COLUMNS = [
    "trans_date_trans_time", "category", "amt", "gender", "state", "city_pop", "merch_lat", "merch_long", "is_fraud", "distance_card_merchant_km",
    "cc_txn_count_prev_1h", "cc_amt_sum_prev_1h", "cc_txn_count_prev_6h", "cc_amt_sum_prev_6h", "cc_txn_count_prev_24h", "cc_amt_sum_prev_24h", "cc_txn_count_prior", "cc_amt_sum_prior",
    "age_years", "hour", "day_of_week", "log1p_amt", "log1p_city_pop", "hour_sin", "hour_cos", "day_sin", "day_cos",
]


def without_personal(df: DataFrame) -> DataFrame:
    return df.select(*[c for c in SAMPLE_COLUMNS if c in df.columns])
