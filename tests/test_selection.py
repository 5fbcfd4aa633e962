import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.functions import selection
from tallystream.functions.selection import Bracket, gathered, quantiles, sketched, totals_of, values_at_places


def frame(spark, n, seed=0):
    draw = np.random.default_rng(seed)
    a, b = draw.normal(size=n), draw.integers(0, 4, n).astype(float)
    c = np.where(draw.random(n) < 0.6, 0.0, draw.exponential(size=n) ** 5)
    rows = [(float(x), float(y), None if i % 3 == 0 else float(z)) for i, (x, y, z) in enumerate(zip(a, b, c, strict=True))]
    return spark.createDataFrame(rows, "a double, b double, c double").repartition(3), [a, b, np.array([r[2] for r in rows if r[2] is not None])]


@pytest.mark.parametrize(("n", "grid", "fit"), [(1, 10, 5), (2, 10, 5), (7, 1000, 5), (3000, 20, 40), (3000, 1000, 10**6)])
def test_quantiles_are_exact(spark, n, grid, fit):
    df, values = frame(spark, n)
    shares = [0.0, 0.005, 0.25, 0.5, 0.61, 0.995, 1.0]
    got = quantiles(df, {c: F.col(c) for c in "abc"}, shares, grid=grid, fit=fit)
    for name, own in zip("abc", values, strict=True):
        if len(own):
            assert got[name] == pytest.approx(np.quantile(own, shares).tolist(), abs=1e-12)
        else:
            assert name not in got
    assert quantiles(df.limit(0), {c: F.col(c) for c in "abc"}, shares) == {}


def test_a_wrong_sketch_does_not_change_the_result(spark):
    df, (a, *_) = frame(spark, 500)
    columns = {"a": F.col("a")}
    got = values_at_places(df, columns, {"a": {0, 100, 499}}, totals_of(df, columns), sketches={"a": [99.0] * 11}, fit=20)
    assert got == {"a": {p: float(np.sort(a)[p]) for p in (0, 100, 499)}}
    with pytest.raises(ValueError, match="no place"):
        values_at_places(df, columns, {"a": {500}}, {"a": 500})


def test_few_rows_are_shuffled(spark, monkeypatch):
    df, (a, *_) = frame(spark, 40_000)
    seen = []
    real = selection.gathered
    monkeypatch.setattr(selection, "gathered", lambda d, c, b: seen.append(real(d, c, b).distinct().count()) or real(d, c, b))
    got = quantiles(df, {c: F.col(c) for c in "abc"}, [0.005, 0.5, 0.995])
    assert got["a"] == pytest.approx(np.quantile(a, [0.005, 0.5, 0.995]).tolist()) and len(seen) == 1 and sum(seen) < 0.05 * 3 * 40_000


def test_brackets(spark):
    df, _ = frame(spark, 100)
    assert len(sketched(df, {"b": F.col("b")}, 10)["b"]) == 11 and sketched(df, {}) == {}
    assert gathered(df, {"b": F.col("b")}, [Bracket("b", 2.0, 2.0), Bracket("b", 1.0, float("inf"))]).filter("bracket = 0 and value <> 2.0").count() == 0
