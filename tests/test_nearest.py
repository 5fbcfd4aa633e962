import numpy as np
import pytest

from tallystream.operators.imbalance import numbered
from tallystream.operators.nearest import nearest


def points(n, copies, seed=2):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 3)) + 4 * draw.integers(0, 3, (n, 1)), 2)
    x[-copies:] = x[0]
    c = draw.integers(0, 3, (n, 2)).astype(str)
    c[-copies:] = c[0]
    return x, c


def brute(x, c, k, penalty):
    out = {}
    for i in range(len(x)):
        far = ((x - x[i]) ** 2).sum(axis=1)
        for j in range(c.shape[1]):
            far = far + penalty**2 * (c[:, j] != c[i, j])
        far[i] = np.inf
        out[i] = np.argsort(far, kind="stable")[:k].tolist()
    return out


@pytest.mark.parametrize(("pivots", "block"), [(8, 50), (1, 5000)])
def test_nearest_are_exact(spark, pivots, block):
    x, c = points(2000, 300)
    df = spark.createDataFrame([(i, [float(v) for v in a], list(b)) for i, (a, b) in enumerate(zip(x, c.tolist(), strict=True))], "id long, x array<double>, c array<string>").repartition(3)
    got = {r.id: [e.id for e in r.near] for r in nearest(df, 5, penalty=1.3, pivots=pivots, block=block).collect()}
    assert got == brute(x, c, 5, 1.3)


def test_few_points(spark):
    df = spark.createDataFrame([(0, [1.0], []), (1, [2.0], []), (2, [9.0], [])], "id long, x array<double>, c array<string>")
    assert {r.id: [(e.id, e.far) for e in r.near] for r in nearest(df, 5).collect()} == {0: [(1, 1.0), (2, 64.0)], 1: [(0, 1.0), (2, 49.0)], 2: [(1, 49.0), (0, 64.0)]}
    only = spark.createDataFrame([(i, [], ["a" if i else "b"]) for i in range(4)], "id long, x array<double>, c array<string>")
    assert {r.id: [e.id for e in r.near] for r in nearest(only, 2).collect()} == {0: [1, 2], 1: [2, 3], 2: [1, 3], 3: [1, 2]}
    assert nearest(df.limit(0), 2).count() == 0


def test_numbers_follow_the_keys(spark):
    rows = spark.createDataFrame([(f"k{i:03d}", i) for i in range(100)], "key string, v int").repartition(5)
    assert all(r.id == r.v for r in numbered(rows, "key").collect())


def test_visits_of_a_point_do_not_grow_with_the_points(spark, monkeypatch):
    from tallystream.operators import nearest as module

    counted, real = {}, module.written

    def written(df, name):
        out = real(df, name)
        counted[name] = out.count()
        return out

    monkeypatch.setattr(module, "written", written)
    x = np.random.default_rng(5).random((12_000, 2)).round(5)
    df = spark.createDataFrame([(i, [float(v) for v in a], ["a"]) for i, a in enumerate(x)], "id long, x array<double>, c array<string>").repartition(3)
    got = {r.id: [e.id for e in r.near] for r in nearest(df, 5, block=50).filter("id % 60 = 0").collect()}
    assert counted["visits"] < 5 * len(x)
    assert got == {i: brute_of(x, i, 5) for i in range(0, len(x), 60)}


def brute_of(x, i, k):
    far = ((x - x[i]) ** 2).sum(axis=1)
    far[i] = np.inf
    return np.argsort(far, kind="stable")[:k].tolist()


def test_boxes_of_categories(spark):
    draw = np.random.default_rng(9)
    c = np.array([[f"l{v:03d}" for v in row] for row in draw.integers(0, 40, (900, 3))])
    x = draw.integers(0, 3, (900, 1)).astype(float)
    df = spark.createDataFrame([(i, [float(v) for v in a], list(b)) for i, (a, b) in enumerate(zip(x, c.tolist(), strict=True))], "id long, x array<double>, c array<string>")
    assert {r.id: [e.id for e in r.near] for r in nearest(df, 4, penalty=0.7, block=40).collect()} == brute(x, c, 4, 0.7)


def test_votes_take_the_first_of_equally_frequent_categories():
    import pyarrow as pa

    from tallystream.operators.imbalance import _votes

    lists = pa.array([["b", "x"], ["a", "x"], ["b", "y"], ["a", "z"], ["c", "q"]])
    assert [v.to_pylist() for v in _votes(lists, np.array([0, 4]), np.array([4, 1]), 2)] == [["a", "c"], ["x", "q"]]
