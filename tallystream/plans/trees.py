"""Boosted trees and contributions over the line items."""

from __future__ import annotations

from itertools import combinations
from math import factorial

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallystream.operators import trees
from tallystream.operators.boosting import BoostConfig, fit_boosted
from tallystream.plans import learning, tables

#: Seconds at which training and validation rows end.
CUTS = ("1998-01-01 00:00:00", "1999-01-01 00:00:00")
CONFIG = BoostConfig(rounds=20, rate=0.4, depth=3, patience=5, bins=32)


def boosted_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Late line items scored by trees that were boosted on early ones and stopped by those between, with the three features that
    contribute most and what the contributions leave of the margin."""
    rows = learning._lines(spark, sf_dir).withColumn("key", F.concat_ws(":", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey"))
    first, second = (F.unix_timestamp(F.lit(c)) for c in CUTS)
    found = fit_boosted(rows.filter(F.col("t") < first), rows.filter((F.col("t") >= first) & (F.col("t") < second)), learning._FEATURES, config=CONFIG)
    late = rows.filter(F.col("t") >= second).select("l_orderkey", "l_linenumber", "label", F.array(*[F.col(c).cast("double") for c in learning._FEATURES]).alias("vector"))
    out = trees.score_rows(late, found.model, drivers=len(learning._FEATURES))
    rest = F.ln(F.col("p") / (1 - F.col("p"))) - F.col("expected") - F.aggregate("drivers", F.lit(0.0), lambda a, d: a + d["contribution"])
    names = F.array_join(F.transform(F.slice("drivers", 1, 3), lambda d: d["feature"]), ",")
    return out.select("l_orderkey", "l_linenumber", "label", F.round("p", 6).alias("p"), names.alias("drivers"), F.round(F.abs(rest), 6).alias("rest"))


#: Trees whose contributions are also worked out by definition: (feature, threshold, left, right) or a leaf's value, and the rows of
#: each branch. Features come again on a path, and one of the trees has a single split.
FIXED_FEATURES = ("l_quantity", "l_discount", "l_tax")
FIXED_TREES = (
    (0, 24.0, (1, 0.045, -0.7, 60.0, (0, 11.0, 0.1, 25.0, 0.9, 15.0), 40.0), 100.0, (2, 0.035, (1, 0.075, -0.2, 30.0, 1.3, 20.0), 50.0, 0.4, 30.0), 80.0),
    (1, 0.02, 0.25, 35.0, -0.35, 145.0),
    (2, 0.055, (0, 37.0, (2, 0.015, 0.6, 20.0, -0.1, 55.0), 75.0, 0.05, 25.0), 100.0, (0, 7.0, -0.9, 12.0, (1, 0.095, 0.3, 44.0, -1.1, 24.0), 68.0), 80.0),
)
FIXED_WEIGHTS = (1.0, 0.5, 2.0)


def _tree(spec: tuple) -> trees.Tree:
    """Nodes of a nested specification: (feature, threshold, left, rows left, right, rows right)."""
    nodes: list = []

    def add(part: tuple | float, cover: float) -> int:
        at = len(nodes)
        nodes.append(None)
        if isinstance(part, float):
            nodes[at] = (-1, 0.0, -1, -1, part, cover)
        else:
            f, threshold, left, n_left, right, n_right = part
            nodes[at] = (f, threshold, add(left, n_left), add(right, n_right), 0.0, cover)
        return at

    add(spec, spec[3] + spec[5])
    return trees.Tree.of(nodes)


def tree_contributions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Contributions of three features of every line item in given trees."""
    model = trees.Ensemble(FIXED_FEATURES, tuple(_tree(t) for t in FIXED_TREES), FIXED_WEIGHTS, -0.2)
    rows = tables.table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.array(*[F.col(c).cast("double") for c in FIXED_FEATURES]).alias("vector"))
    out = trees.score_rows(rows, model, drivers=len(FIXED_FEATURES))
    of = lambda f: F.filter("drivers", lambda d: d["feature"] == f)[0]["contribution"]
    return out.select("l_orderkey", "l_linenumber", F.round("p", 6).alias("p"), F.round("expected", 6).alias("expected"), *[F.round(of(f) + F.lit(0.0), 6).alias(f"c_{f}") for f in FIXED_FEATURES])


def _value(part: tuple | float, known: tuple[int, ...]) -> str:
    """The expectation of a tree where the features ``known`` are those of the row, as SQL."""
    if isinstance(part, float):
        return repr(part)
    f, threshold, left, n_left, right, n_right = part
    a, b = _value(left, known), _value(right, known)
    if f in known:
        return f"CASE WHEN {FIXED_FEATURES[f]} <= {threshold} THEN {a} ELSE {b} END"
    return f"(({n_left} * ({a}) + {n_right} * ({b})) / {n_left + n_right})"


def _contribution_sql() -> str:
    """By definition: weighted differences over all sets of the other features."""
    n, values = len(FIXED_FEATURES), {}
    for k in range(n + 1):
        for known in combinations(range(n), k):
            values[known] = " + ".join(f"{w} * ({_value(t, known)})" for t, w in zip(FIXED_TREES, FIXED_WEIGHTS, strict=True))
    name = lambda known: "v" + "".join(map(str, known))
    parts = []
    for i, feature in enumerate(FIXED_FEATURES):
        terms = [f"{factorial(len(s)) * factorial(n - len(s) - 1) / factorial(n)} * ({name(tuple(sorted((*s, i))))} - {name(s)})" for s in values if i not in s]
        parts.append(f"round({' + '.join(terms)}, 6) + 0.0 AS c_{feature}")
    columns = ", ".join(f"CAST({sql} AS DOUBLE) AS {name(known)}" for known, sql in values.items())
    return f"""SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-({name(tuple(range(n)))} - 0.2))), 6) AS p, round({name(())} - 0.2, 6) AS expected, {', '.join(parts)} FROM (SELECT l_orderkey, l_linenumber, {columns} FROM lineitem)"""


QUERIES = {"boosted_scores": boosted_scores, "tree_contributions": tree_contributions}
SQL = {"tree_contributions": _contribution_sql()}
