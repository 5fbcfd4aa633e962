"""Exact order statistics of columns, without sorting or shuffling their values.

One pass makes a sketch of every column, whose values at a grid of shares give for each wanted place a bracket that holds it. A
second one counts the rows below and inside each bracket, and a third one gathers the rows inside, some thousandths of all, counted
by value. A bracket that holds too many rows is narrowed by a sketch of what is inside, and counted again, before it is gathered.
Sketches only choose brackets: places are proven by the counts, so results are exact.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tallystream.functions.ranges import between

#: Steps of the grid of shares; rows of a bracket that are gathered without narrowing it; times a bracket is narrowed at most.
GRID, FIT, TIMES = 1000, 1_000_000, 4
INF = float("inf")


@dataclass
class Bracket:
    """Values from ``low`` to ``high`` of a column, both included, with the places wanted inside."""

    column: str
    low: float
    high: float
    places: set[int] = field(default_factory=set)
    below: int = 0
    inside: int = 0

    def holds(self, value: Column) -> Column:
        out = value.isNotNull()
        if self.low > -INF:
            out &= value >= self.low
        if self.high < INF:
            out &= value <= self.high
        return out


def sketched(df: DataFrame, columns: dict[str, Column], grid: int = GRID) -> dict[str, list[float]]:
    """About the values at the shares 0, 1 / grid, ... of each column, from one pass; none for a column without values."""
    if not columns:
        return {}
    safe = df.select(*[c.cast("double").alias(f"c{i}") for i, c in enumerate(columns.values())])
    found = safe.approxQuantile([f"c{i}" for i in range(len(columns))], [i / grid for i in range(grid + 1)], 0.5 / grid)
    return dict(zip(columns, found, strict=True))


def _bracket(column: str, values: list[float], share: float, low: float, high: float) -> tuple[float, float]:
    """The grid's values two steps and more around a share; the whole range beyond its ends."""
    steps = len(values) - 1
    first, last = math.floor(share * steps) - 2, math.ceil(share * steps) + 2
    return (values[first] if first > 0 else low), (values[last] if last < steps else high)


def _counted(df: DataFrame, columns: dict[str, Column], brackets: list[Bracket]) -> None:
    """Count the rows below and inside each bracket."""
    if not brackets:
        return
    below = [F.count_if(columns[b.column] < b.low) if b.low > -INF else F.lit(0).cast("long") for b in brackets]
    found = df.agg(*[c.alias(f"b{i}") for i, c in enumerate(below)], *[F.count_if(b.holds(columns[b.column])).alias(f"i{i}") for i, b in enumerate(brackets)]).first()
    for i, b in enumerate(brackets):
        b.below, b.inside = found[f"b{i}"], found[f"i{i}"]


def gathered(df: DataFrame, columns: dict[str, Column], brackets: list[Bracket]) -> DataFrame:
    """(bracket, value) of the rows inside the brackets."""
    parts = [F.when(b.holds(columns[b.column]), F.struct(F.lit(i).alias("bracket"), (columns[b.column] + 0.0).alias("value"))) for i, b in enumerate(brackets)]
    return df.select(F.explode(F.array_compact(F.array(*parts))).alias("x")).select("x.*")


def values_at_places(df: DataFrame, columns: dict[str, Column], places: dict[str, set[int]], totals: dict[str, int], *, sketches: dict[str, list[float]] | None = None, grid: int = GRID, fit: int = FIT) -> dict[str, dict[int, float]]:
    """The values at places (from 0) of each column's order. ``columns`` are doubles, null where a row does not count and never
    NaN; ``totals`` has the number of their values."""
    sketches = sketched(df, columns, grid) if sketches is None else sketches
    known: dict[tuple, Bracket] = {}
    for name, wanted in places.items():
        for place in wanted:
            if not 0 <= place < totals.get(name, 0):
                raise ValueError(f"{name} has no place {place}")
            ends = _bracket(name, sketches[name], place / max(1, totals[name] - 1), -INF, INF)
            known.setdefault((name, *ends), Bracket(name, *ends)).places.add(place)
    brackets = list(known.values())
    _counted(df, columns, brackets)
    # A sketch may be further off than it says; then all values are looked at.
    for b in brackets:
        if any(not b.below <= p < b.below + b.inside for p in b.places):
            b.low, b.high, b.below, b.inside = -INF, INF, 0, totals[b.column]
    done, open_ = [], brackets
    for _ in range(TIMES):
        done, open_ = done + [b for b in open_ if b.inside <= fit or b.low == b.high], [b for b in open_ if b.inside > fit and b.low != b.high]
        if not open_:
            break
        inner = {f"n{i}": F.when(b.holds(columns[b.column]), columns[b.column]) for i, b in enumerate(open_)}
        finer, tried = sketched(df, inner, grid), {}
        for i, b in enumerate(open_):
            for place in b.places:
                ends = _bracket(b.column, finer[f"n{i}"], (place - b.below) / max(1, b.inside - 1), b.low, b.high)
                tried.setdefault((i, *ends), Bracket(b.column, *ends)).places.add(place)
        narrow = list(tried.values())
        _counted(df, columns, narrow)
        old, open_ = open_, []
        for (i, *_), b in tried.items():
            good = all(b.below <= p < b.below + b.inside for p in b.places)
            better = b if good else Bracket(b.column, old[i].low, old[i].high, b.places, old[i].below, old[i].inside)
            # What can't be halved is many rows of few values, which are counted by value before they are shuffled.
            (open_ if good and 2 * b.inside <= old[i].inside else done).append(better)
    done += open_
    out: dict[str, dict[int, float]] = {name: {} for name in places}
    for b in done:
        if b.low == b.high:
            out[b.column].update(dict.fromkeys(b.places, b.low + 0.0))
    rest = [b for b in done if b.low != b.high]
    if rest:
        counts = gathered(df, columns, rest).groupBy("bracket", "value").agg(F.count("*").alias("n"))
        start = F.create_map(*[F.lit(x) for i, b in enumerate(rest) for x in (i, b.below)])
        upto = counts.withColumn("upto", start[F.col("bracket")] + F.sum("n").over(Window.partitionBy("bracket").orderBy("value")))
        wanted = df.sparkSession.createDataFrame([(i, p) for i, b in enumerate(rest) for p in sorted(b.places)], "b int, place long")
        hit = upto.join(F.broadcast(wanted), F.col("bracket") == F.col("b")).filter((F.col("upto") > F.col("place")) & (F.col("upto") - F.col("n") <= F.col("place")))
        for r in hit.select("bracket", "place", "value").collect():  # a row per place
            out[rest[r["bracket"]].column][r["place"]] = r["value"]
    return out


def totals_of(df: DataFrame, columns: dict[str, Column]) -> dict[str, int]:
    found = df.agg(F.lit(0).alias("none"), *[F.count(c).alias(f"c{i}") for i, c in enumerate(columns.values())]).first()
    return {name: found[f"c{i}"] for i, name in enumerate(columns)}


def quantiles(df: DataFrame, columns: dict[str, Column], shares: list[float], *, totals: dict[str, int] | None = None, sketches: dict[str, list[float]] | None = None, grid: int = GRID, fit: int = FIT) -> dict[str, list[float]]:
    """Exact, interpolated quantiles of each column that has values."""
    totals = totals_of(df, columns) if totals is None else totals
    spots = {name: [s * (n - 1) for s in shares] for name, n in totals.items() if n}
    found = values_at_places(df, columns, {name: {x for p in ps for x in (math.floor(p), math.ceil(p))} for name, ps in spots.items()}, totals, sketches=sketches, grid=grid, fit=fit) if spots else {}
    return {name: [between(p, found[name]) for p in ps] for name, ps in spots.items()}
