"""Constraint checks: each is one aggregation, and raises with the number of rows that break it."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.ranges import cuts, range_of
from tallystream.functions.scalars import cents_valid, coordinates_valid, event_seconds

#: Tokens for a missing and for an unseen category.
MISSING, UNKNOWN = "__MISSING__", "__UNKNOWN__"


def drop_export_index(df: DataFrame) -> DataFrame:
    """Drop columns named like a spreadsheet's unnamed index."""
    return df.drop(*[c for c in df.columns if re.fullmatch(r"unnamed:\s*\d+", c, re.IGNORECASE)])


def index_mismatches(df: DataFrame, index: str, row: str) -> DataFrame:
    return df.agg(F.count_if(~F.col(index).eqNullSafe(F.col(row))).alias("mismatches"))


def require_columns(df: DataFrame, names: list[str]) -> None:
    if missing := sorted(set(names) - set(df.columns)):
        raise ValueError(f"missing columns: {', '.join(missing)}")


def violations(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row: for each rule, how many rows do not satisfy it (null counts as not satisfied)."""
    return df.agg(*[F.count_if(~F.coalesce(rule, F.lit(False))).alias(name) for name, rule in rules.items()])


def enforce(df: DataFrame, rules: dict[str, Column]) -> int:
    """Raise a ValueError that names the rules that rows break; return the number of rows."""
    found = df.agg(F.count("*"), *[F.count_if(~F.coalesce(rule, F.lit(False))) for rule in rules.values()]).first()
    if broken := {k: v for k, v in zip(rules, found[1:], strict=True) if v}:
        raise ValueError("invalid rows: " + ", ".join(f"{k} ({v})" for k, v in sorted(broken.items())))
    return found[0]


def transaction_rules(time: str = "unix_time", amount: str = "amt", label: str | None = "is_fraud") -> dict[str, Column]:
    rules = {"time": event_seconds(F.col(time)).isNotNull(), "amount": cents_valid(F.col(amount))}
    return rules | ({"label": F.col(label).isin(0, 1)} if label else {})


def distance_or_null(lat: Column, lon: Column, lat2: Column, lon2: Column, distance: Column) -> Column:
    """The distance where both places are valid."""
    return F.when(coordinates_valid(lat, lon) & coordinates_valid(lat2, lon2), distance)


def backsteps(df: DataFrame, clocks: list[str], row: str) -> DataFrame:
    """One row: for each clock, how many rows are earlier than the row before.

    Rows are compared with their neighbour inside ranges of ``row``, and then the ranges' ends, so no task sees all rows.
    """
    rows = df.select(row, *clocks).withColumn("__p", range_of(F.col(row), cuts(df, row)))
    inside = Window.partitionBy("__p").orderBy(row)
    steps = rows.select("__p", row, *clocks, *[F.lag(c).over(inside).alias(f"__{c}") for c in clocks])
    first = [F.min_by(F.col(c), F.col(row)).alias(f"f_{c}") for c in clocks]
    last = [F.max_by(F.col(c), F.col(row)).alias(f"l_{c}") for c in clocks]
    parts_of = steps.groupBy("__p").agg(*[F.count_if(F.col(c) < F.col(f"__{c}")).alias(c) for c in clocks], *first, *last, F.min(row).alias("__start"))
    seams = Window.orderBy("__start")  # one row per range
    whole = parts_of.select(*[(F.col(c) + F.coalesce((F.col(f"f_{c}") < F.lag(f"l_{c}").over(seams)).cast("int"), F.lit(0))).alias(c) for c in clocks])
    return whole.agg(*[F.sum(c).cast("long").alias(c) for c in clocks])


def duplicate_keys(df: DataFrame, key: str) -> DataFrame:
    """Keys that more than one row has."""
    return df.groupBy(key).count().filter("count > 1")


def shared_keys(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """Keys that both tables have."""
    return left.select(key).intersect(right.select(key))


def fill_category(value: Column) -> Column:
    return F.coalesce(value.cast("string"), F.lit(MISSING))


def uses_reserved(value: Column) -> Column:
    return F.coalesce(value.cast("string").isin(MISSING, UNKNOWN), F.lit(False))


def normalize_transactions(df: DataFrame, columns: list[str], *, text: list[str], numeric: list[str], positive: list[str] = (), max_rows: int = 10_000) -> DataFrame:
    """Whitelist, trim and type uploaded rows; the whole batch is rejected on the first broken rule.

    Text must not be empty, numbers must be finite, and those in ``positive`` above 0. Entity numbers must not be
    floating-point, since these lose digits.
    """
    require_columns(df, columns)
    kinds = dict(df.dtypes)
    if lossy := [c for c in text if kinds[c] in ("double", "float")]:
        raise ValueError(f"identifiers as floating-point numbers lose digits: {', '.join(lossy)}")
    if df.limit(max_rows + 1).count() > max_rows:
        raise ValueError(f"more than {max_rows} rows")
    rows = df.select(*[F.trim(F.col(c).cast("string")).alias(c) if c in text else F.col(c).try_cast("double").alias(c) if c in numeric else F.col(c) for c in columns])
    rules = {c: F.length(c) > 0 for c in text}
    rules |= {c: F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) != float("inf")) for c in numeric}
    rules |= {f"{c}_positive": F.col(c) > 0 for c in positive}
    enforce(rows, rules)
    return rows
