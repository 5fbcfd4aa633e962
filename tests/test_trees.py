import itertools
import math

import numpy as np
import pytest
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tallystream.operators import boosting, models, neural, trees
from tallystream.operators.boosting import BoostConfig, fit_boosted
from tallystream.operators.trees import Ensemble, Tree


def random_tree(draw, depth, features):
    nodes = []

    def grow(level, cover):
        at = len(nodes)
        nodes.append(None)
        if level == depth or draw.random() < 0.15:
            nodes[at] = (-1, 0.0, -1, -1, float(draw.normal()), cover)
        else:
            share = float(draw.uniform(0.1, 0.9))
            left, right = grow(level + 1, cover * share), grow(level + 1, cover * (1 - share))
            nodes[at] = (int(draw.integers(features)), float(draw.normal()), left, right, 0.0, cover)
        return at

    grow(0, 100.0)
    return Tree.of(nodes)


def slow_contributions(model, x):
    """By definition: over all subsets of features, with expectations by recursion."""
    n = len(model.names)

    def value(tree, node, known):
        f = tree.feature[node]
        if f < 0:
            return tree.value[node]
        left, right = tree.left[node], tree.right[node]
        if f in known:
            return value(tree, left if x[f] <= tree.threshold[node] else right, known)
        return (tree.cover[left] * value(tree, left, known) + tree.cover[right] * value(tree, right, known)) / tree.cover[node]

    of = {s: sum(w * value(t, 0, s) for t, w in zip(model.trees, model.weights)) for k in range(n + 1) for s in itertools.combinations(range(n), k)}
    out = np.zeros(n)
    for i in range(n):
        for s in of:
            if i not in s:
                out[i] += math.factorial(len(s)) * math.factorial(n - len(s) - 1) / math.factorial(n) * (of[tuple(sorted((*s, i)))] - of[s])
    return out, model.base + of[()]


@pytest.mark.parametrize(("depth", "patterns"), [(1, 8), (3, 8), (5, 8), (5, 1)])
def test_contributions_are_exact(depth, patterns, monkeypatch):
    monkeypatch.setattr(trees, "PATTERNS", patterns)
    draw = np.random.default_rng(depth)
    model = Ensemble(("a", "b", "c", "d", "e"), tuple(random_tree(draw, depth, 5) for _ in range(4)), (1.0, 0.5, 2.0, 0.1), 0.7)
    x = draw.normal(size=(40, 5))
    x[3, 1] = x[4, 0] = np.nan
    x[5] = model.trees[0].threshold[0]  # ties go to the left
    got = model.contributions(x)
    assert got.sum(axis=1) + model.expected == pytest.approx(model.margin(x), abs=1e-9)
    for row, own in zip(x, got, strict=True):
        want, expected = slow_contributions(model, row)
        assert own == pytest.approx(want, abs=1e-9) and model.expected == pytest.approx(expected)


def test_documents_and_drivers(spark):
    draw = np.random.default_rng(1)
    model = Ensemble(("a", "b", "c"), tuple(random_tree(draw, 3, 3) for _ in range(3)), (1.0, 1.0, 1.0))
    again = Ensemble.from_dict(model.to_dict(), ["a", "b", "c"])
    x = draw.normal(size=(30, 3))
    assert (again.margin(x) == model.margin(x)).all()
    with pytest.raises(ValueError, match="other inputs"):
        Ensemble.from_dict(model.to_dict(), ["a", "b"])
    with pytest.raises(ValueError, match="changed"):
        Ensemble.from_dict(model.to_dict() | {"base": 1.0})
    rows = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "i int, vector array<double>")
    for r in trees.score_rows(rows, model, drivers=2).collect():
        own = model.contributions(x[r.i : r.i + 1])[0]
        order = np.argsort(-np.abs(own))[:2]
        assert [d.feature for d in r.drivers] == [model.names[j] for j in order] and [d.contribution for d in r.drivers] == pytest.approx(own[order])
        assert [d.direction for d in r.drivers] == ["higher_risk" if own[j] > 0 else "lower_risk" for j in order]
        assert r.p == pytest.approx(model.probability(x[r.i : r.i + 1])[0]) and r.expected == model.expected
    assert trees.score_rows(rows.limit(0), model, drivers=2).count() == 0


def table(spark, n=3000, seed=0):
    draw = np.random.default_rng(seed)
    x = np.round(draw.normal(size=(n, 3)), 2)
    y = (draw.random(n) < 1 / (1 + np.exp(3 - 2 * x[:, 0] - 2 * (x[:, 0] * x[:, 1] > 0.3)))).astype(int)
    rows = [(f"k{i}", int(y[i]), *[float(v) for v in x[i]]) for i in range(n)]
    rows = [(k, v, None if i % 50 == 0 else a, b, float("nan") if i % 60 == 0 else c) for i, (k, v, a, b, c) in enumerate(rows)]
    return spark.createDataFrame(rows, "key string, label int, a double, b double, c double")


FEATURES = ["a", "b", "c"]


def matrix(df):
    data = df.orderBy("key").toPandas()
    return data[FEATURES].to_numpy(dtype=float), data["label"].to_numpy()


def test_a_spark_model_as_an_ensemble(spark):
    rows = VectorAssembler(inputCols=FEATURES, outputCol="features").transform(table(spark, 800).na.fill(0.0))
    model = models.fit("boosted", {"rounds": 4, "depth": 3, "rate": 0.2}, rows)
    own = trees.from_spark(model, FEATURES)
    scored = models.score(model, rows).orderBy("key").toPandas()
    assert own.probability(scored[FEATURES].to_numpy()) == pytest.approx(scored["p"].to_numpy(), abs=1e-12)
    x = scored[FEATURES].to_numpy()[:5]
    assert own.contributions(x)[0] == pytest.approx(slow_contributions(own, x[0])[0])


def slow_boost(x, y, edges, config, rounds):
    """Level by level over all features, without samples of rows or features."""
    bins = np.stack([np.where(np.isnan(x[:, i]), len(e), np.searchsorted(e, x[:, i], side="left")) for i, e in enumerate(edges)], axis=1)
    margin, out = np.zeros(len(x)), []
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-margin))
        g, h = np.rint((p - y) * boosting.UNIT) / boosting.UNIT, np.rint(p * (1 - p) * boosting.UNIT) / boosting.UNIT
        at, leaves = np.zeros(len(x), dtype=int), 1
        for _ in range(config.depth):
            split = {}
            for node in range(leaves):
                rows = at == node
                best = (1e-9, None)
                for f in range(x.shape[1]):
                    for b in range(config.bins - 1):
                        left = rows & (bins[:, f] <= b)
                        right = rows & ~left
                        if h[left].sum() >= config.child_weight and h[right].sum() >= config.child_weight:
                            gain = sum(g[s].sum() ** 2 / (h[s].sum() + config.l2) * sign for s, sign in ((left, 1), (right, 1), (rows, -1)))
                            if gain > best[0] + 1e-12:
                                best = (gain, (f, b))
                split[node] = best[1]
            new, count = np.zeros(len(x), dtype=int), 0
            for node in range(leaves):
                rows = at == node
                if split[node] is None:
                    new[rows], count = count, count + 1
                else:
                    f, b = split[node]
                    new[rows & (bins[:, f] <= b)], new[rows & (bins[:, f] > b)] = count, count + 1
                    count += 2
            at, leaves = new, count
        for node in range(leaves):
            margin[at == node] -= config.rate * g[at == node].sum() / (h[at == node].sum() + config.l2)
        out.append(margin.copy())
    return out


def test_boosting_equals_a_slow_one(spark):
    config = BoostConfig(rounds=3, rate=0.3, depth=2, child_weight=3.0, rows=1.0, columns=1.0, bins=8, together=2)
    rows = table(spark, 500)
    found = fit_boosted(rows.repartition(5), rows, FEATURES, config=config)
    x, y = matrix(rows)
    want = slow_boost(x, y, boosting.bin_edges(rows, FEATURES, 8), config, 3)
    assert [found.model.first(i + 1).margin(x) for i in range(found.best_round)] == [pytest.approx(m, abs=1e-6) for m in want[: found.best_round]]


def test_it_stops_at_the_best_average_precision(spark):
    train, valid = table(spark, 3000), table(spark, 1200, 1)
    config = BoostConfig(rounds=60, rate=0.5, depth=4, child_weight=1.0, patience=4, together=3, bins=32, positive_weight=2.0)
    found = fit_boosted(train, valid, FEATURES, config=config)
    x, y = matrix(valid)
    assert len(found.model.trees) == found.best_round and len(found.history) == found.best_round + config.patience < 60
    for i in (1, found.best_round):
        assert found.history[i - 1] == pytest.approx(neural.average_precision(y, found.model.first(i).probability(x)), abs=1e-9)
    assert found.history[found.best_round - 1] == max(found.history) > 1.5 * y.mean()
    again = fit_boosted(train.repartition(7).orderBy("b"), valid, FEATURES, config=config)
    assert again.model.to_dict() == found.model.to_dict() and again.history == pytest.approx(found.history, abs=1e-12)


def test_odd_tables(spark):
    rows = table(spark, 200)
    with pytest.raises(ValueError, match="classes"):
        fit_boosted(rows.filter("label = 0"), rows, FEATURES)
    with pytest.raises(ValueError, match="one byte"):
        BoostConfig(bins=300)
    empty = rows.withColumn("a", F.lit(None).cast("double")).withColumn("b", F.lit(1.0))
    found = fit_boosted(empty, rows, ["a", "b"], config=BoostConfig(rounds=2, together=1, bins=4))
    assert found.best_round == 1 and set(found.model.trees[0].feature) == {-1}
