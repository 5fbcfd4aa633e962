"""Ranges of an ordered column, as a function of the value alone, and exact order statistics by them.

Work over a whole order is done inside ranges, and what crosses them is carried over from one row per range. Ranges are cut
at approximate quantiles, so they hold about equally many rows; any cuts give right results.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MOST = 200


def cuts(df: DataFrame, column: str, most: int = MOST) -> list[float]:
    """Ascending cut points, at most ``most`` - 1, and no more ranges than shuffle partitions."""
    return cuts_by(df, [column], most)[column]


def cuts_by(df: DataFrame, columns: list[str], most: int = MOST) -> dict[str, list[float]]:
    """Cut points of several columns, in one pass."""
    parts = min(most, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    if parts < 2 or not columns:
        return {c: [] for c in columns}
    safe = df.select(*[F.col(c).cast("double").alias(f"c{i}") for i, c in enumerate(columns)])
    found = safe.approxQuantile([f"c{i}" for i in range(len(columns))], [i / parts for i in range(1, parts)], 0.25 / parts)
    return {c: sorted(set(v)) for c, v in zip(columns, found, strict=True)}


def range_of(value: Column, at: list[float]) -> Column:
    """The number of the value's range: how many cuts are not above it."""
    return F.size(F.filter(F.lit(at), lambda c: c <= value)) if at else F.lit(0)


def values_at(counts: DataFrame, at: dict[str, list[float]], places: dict[str, list[int]]) -> dict[str, dict[int, float]]:
    """The values at given places (from 0) of each feature's order.

    ``counts`` has (feature, value, n), each value once. Only the ranges that hold a place are put in order, each in a task of
    its own; the driver gets a row per feature and range, and one per place.
    """
    where = F.coalesce(*[F.when(F.col("feature") == f, range_of(F.col("value"), c)) for f, c in at.items()], F.lit(0))
    ranged = counts.withColumn("__p", where)
    before: dict[str, list[tuple[int, int, int]]] = {}
    for r in ranged.groupBy("feature", "__p").agg(F.sum("n").alias("n")).orderBy("feature", "__p").collect():
        known = before.setdefault(r["feature"], [])
        start = known[-1][1] + known[-1][2] if known else 0
        known.append((r["__p"], start, r["n"]))
    wanted = [(f, p, start, place) for f, places_of in places.items() for place in sorted(set(places_of)) for p, start, n in before.get(f, []) if start <= place < start + n]
    if not wanted:
        return {f: {} for f in places}
    table = F.broadcast(df_of(counts, wanted, "feature string, __p int, start long, place long"))
    upto = ranged.join(F.broadcast(df_of(counts, sorted({w[:3] for w in wanted}), "feature string, __p int, start long")), ["feature", "__p"])
    upto = upto.withColumn("__upto", F.col("start") + F.sum("n").over(Window.partitionBy("feature", "__p").orderBy("value"))).drop("start")
    hit = upto.join(table, ["feature", "__p"]).filter((F.col("__upto") > F.col("place")) & (F.col("__upto") - F.col("n") <= F.col("place")))
    out: dict[str, dict[int, float]] = {f: {} for f in places}
    for r in hit.select("feature", "place", "value").collect():
        out[r["feature"]][r["place"]] = r["value"]
    return out


def df_of(like: DataFrame, rows: list[tuple], schema: str) -> DataFrame:
    return like.sparkSession.createDataFrame(rows, schema)


def between(position: float, value: dict[int, float]) -> float:
    """Linear interpolation between the values at the places below and above a position."""
    low, high = math.floor(position), math.ceil(position)
    return value[low] + (value[high] - value[low]) * (position - low)


def value_counts(long: DataFrame) -> DataFrame:
    """(feature, value, n) of (feature, value)."""
    return long.groupBy("feature", "value").agg(F.count("*").alias("n"))


def exact_quantiles(counts: DataFrame, at: dict[str, list[float]], shares: list[float], totals: dict[str, int] | None = None) -> dict[str, list[float]]:
    """Exact, interpolated quantiles of each feature from the counts of its values; features without values have none."""
    if totals is None:
        totals = {r["feature"]: r["n"] for r in counts.groupBy("feature").agg(F.sum("n").alias("n")).collect()}
    positions = {f: [s * (n - 1) for s in shares] for f, n in totals.items()}
    found = values_at(counts, at, {f: [x for p in ps for x in (math.floor(p), math.ceil(p))] for f, ps in positions.items()})
    return {f: [between(p, found[f]) for p in ps] for f, ps in positions.items()}
