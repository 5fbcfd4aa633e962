import math

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallystream.operators import models, neural
from tallystream.operators.forest import Forest, drawn, fit_forest, sample_weights


def table(spark, n, seed=0):
    draw = np.random.default_rng(seed)
    x = np.round(draw.random((n, 3)), 2)
    y = (draw.random(n) < 0.03 + 0.5 * (x[:, 0] > 0.7)).astype(int)
    return spark.createDataFrame([(f"k{i}", Vectors.dense(x[i].tolist()), int(y[i])) for i in range(n)], ["key", "features", "label"])


def test_draws_are_poisson(spark):
    counts = {r.n: r["count"] for r in spark.range(20_000).select(drawn(F.col("id"), 3, 1).alias("n")).groupBy("n").count().collect()}
    for k in range(4):
        assert counts[k] / 20_000 == pytest.approx(math.exp(-1) / math.factorial(k), abs=0.012)
    two = spark.range(2000).select(F.corr(drawn(F.col("id"), 0, 1).cast("double"), drawn(F.col("id"), 1, 1).cast("double"))).first()[0]
    assert abs(two) < 0.08


def test_each_tree_balances_its_own_sample(spark):
    rows = table(spark, 1500)
    weights = sample_weights(rows, "label", "key", 4, 9)
    assert len(set(weights)) == 4
    for t, (a, b) in enumerate(weights):
        sums = {r.label: r.s for r in rows.withColumn("w", drawn(F.col("key"), t, 9) * F.when(F.col("label") == 1, b).otherwise(a)).groupBy("label").agg(F.sum("w").alias("s")).collect()}
        assert sums[0] == pytest.approx(sums[1])


def slow_stump(x, y, w, leaf):
    """The split of the lowest weighted Gini impurity, the share of positives on both sides."""
    best = (np.inf, None)
    for f in range(x.shape[1]):
        for at in np.unique(x[:, f])[:-1]:
            left = x[:, f] <= at
            if min((w[left] > 0).sum(), (w[~left] > 0).sum()) < leaf:
                continue
            total = 0.0
            for side in (left, ~left):
                p = (w[side] * y[side]).sum() / w[side].sum()
                total += w[side].sum() * 2 * p * (1 - p)
            if total < best[0] - 1e-12:
                best = (total, left)
    left = best[1]
    share = lambda s: (w[s] * y[s]).sum() / w[s].sum()
    return np.where(left, share(left), share(~left))


def test_stumps_equal_slow_ones(spark):
    draw = np.random.default_rng(3)
    x = draw.integers(0, 8, (400, 2)).astype(float)  # few values, so every one is a candidate of Spark's bins
    y = (draw.random(400) < 0.05 + 0.6 * (x[:, 1] > 5)).astype(int)
    rows = spark.createDataFrame([(f"k{i}", Vectors.dense(x[i].tolist()), int(y[i])) for i in range(400)], ["key", "features", "label"])
    forest = fit_forest(rows, trees=3, depth=1, leaf=2, key="key", subset="all", seed=5)
    weights = sample_weights(rows, "label", "key", 3, 5)
    n = rows.select("key", *[drawn(F.col("key"), t, 5).alias(f"n{t}") for t in range(3)]).toPandas().set_index("key").loc[[f"k{i}" for i in range(400)]]
    want = np.mean([slow_stump(x, y, n[f"n{t}"].to_numpy() * np.where(y == 1, weights[t][1], weights[t][0]), 2) for t in range(3)], axis=0)
    assert forest.probability(x) == pytest.approx(want, abs=1e-9)
    got = {r.key: r.p for r in models.score(forest, rows).collect()}
    assert [got[f"k{i}"] for i in range(400)] == pytest.approx(want.tolist(), abs=1e-9)


def test_forests_learn_and_are_kept(spark, tmp_path):
    rows = table(spark, 1200)
    model = models.fit("forest", {"trees": 5, "depth": 4, "leaf": 3}, rows)
    scored = models.score(model, table(spark, 600, 1)).toPandas()
    assert neural.average_precision(scored["label"].to_numpy(), scored["p"].to_numpy()) > 2 * scored["label"].mean()
    path = f"file://{tmp_path}/m"
    seal = models.save(model, path)
    assert models.load(path).to_dict() == model.to_dict() and models.files_digest(spark, path) == seal
    with pytest.raises(ValueError, match="changed"):
        Forest.from_dict(model.to_dict() | {"inputs": 9})
    with pytest.raises(ValueError, match="classes"):
        models.fit("forest", {"trees": 2, "depth": 2, "leaf": 1}, rows.filter("label = 0"))
