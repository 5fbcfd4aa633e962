import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from tallystream.operators import drift, fusion, metrics, models, neural

Y, P = [0, 0, 0, 1, 1], [0.01, 0.20, 0.60, 0.55, 0.90]


@pytest.fixture
def scores(spark):
    return spark.createDataFrame(list(zip(Y, P, strict=True)), "y int, p double")


def test_threshold_and_report(scores):
    report = metrics.evaluate(scores, "y", "p")
    assert report["average_precision"] > 0.75 and report["at_half"]["fp"] == 1
    assert report["selected"]["recall"] == report["at_threshold"]["recall"] and report["selected"]["precision"] == pytest.approx(report["at_threshold"]["precision"])
    assert report["roc_auc"] == pytest.approx(5 / 6)
    assert report["average_precision"] == pytest.approx(neural.average_precision(np.array(Y), np.array(P)))


@pytest.mark.parametrize("rows", [[(0, 0.5), (0, 0.1)], [(0, float("nan")), (1, 0.5)], [(0, 1.1), (1, 0.2)]])
def test_invalid_probabilities(spark, rows):
    with pytest.raises(ValueError):
        metrics.evaluate(spark.createDataFrame(rows, "y int, p double"), "y", "p")


def test_matrix(spark, scores):
    report = metrics.evaluate(scores, "y", "p")
    assert [r["model"] for r in metrics.evaluation_matrix(scores, {"b": report, "a": report}).collect()] == ["a", "b"]


def test_blends(spark):
    rows = spark.createDataFrame([(0.1, 0.9, 0.4), (0.0, 1.0, 0.5)], "a double, b double, c double")
    w = {"a": 0.5, "b": 0.2, "c": 0.3}
    assert [r[0] for r in rows.select(fusion.blend(w)).collect()] == pytest.approx([0.35, 0.35])
    assert all(0 <= r[0] <= 1 for r in rows.select(fusion.blend(w, "logit")).collect())
    with pytest.raises(ValueError):
        fusion.blend(w, "odds")
    tried = fusion.candidates(["a", "b", "c"], 12, 0.05)
    assert len(tried) == 24 and all(sum(c["weights"].values()) == pytest.approx(1) and min(c["weights"].values()) >= 0.05 - 1e-12 for c in tried)


def test_blend_search(spark):
    draw = np.random.default_rng(1)
    y = draw.integers(0, 2, 300)
    rows = spark.createDataFrame([(int(t), float(np.clip(0.5 * t + 0.5 * a, 0, 1)), float(b)) for t, a, b in zip(y, draw.random(300), draw.random(300), strict=True)], "y int, good double, noise double")
    tried = fusion.candidates(["good", "noise"], 6)
    best = fusion.choose(rows, "y", tried)
    assert best.weights["good"] > best.weights["noise"] and {"hybrid_probability", "predicted_fraud"} <= set(best.score(rows).columns)
    sealed = best.to_dict({"good": "A"})
    assert fusion.Hybrid.from_dict(sealed, {"good": "A"}) == best
    with pytest.raises(ValueError):
        fusion.Hybrid.from_dict(sealed, {"good": "B"})


def test_drift(spark):
    draw = np.random.default_rng(3)
    make = lambda shift: spark.createDataFrame([(i, *map(float, r)) for i, r in enumerate(draw.normal(shift, 1, (2000, 2)))], "id int, a double, b double")
    reference, same, moved = make(0), make(0), make(2.5)
    detector = drift.DriftDetector.from_dict(drift.DriftDetector.fit(reference, ["a", "b"], "id").to_dict())
    assert drift.drift_summary(detector.evaluate(same, "id")).first().overall == "stable"
    assert drift.drift_summary(detector.evaluate(moved, "id")).first().overall == "critical"
    assert all(r["psi"] == 0 for r in drift.feature_drift(reference, reference, ["a"]).collect())
    row = drift.distribution_distances(reference, moved, "a").first()
    a, b = (np.sort([r[0] for r in d.select("a").collect()]) for d in (reference, moved))
    grid = np.sort(np.concatenate([a, b]))
    gap = np.abs(np.searchsorted(a, grid, side="right") / len(a) - np.searchsorted(b, grid, side="right") / len(b))
    assert row.ks == pytest.approx(gap.max()) and row.wasserstein == pytest.approx((gap[:-1] * np.diff(grid)).sum())
    assert drift.ks_p_value(row.ks, 2000, 2000) < 1e-6 and drift.ks_p_value(0.0, 10, 10) == 1.0
    shifted = drift.injected_shift(reference.withColumn("p", F.lit(0.5)), ["a"], detector.stats, "p")
    assert shifted.first().p == pytest.approx(1 / (1 + np.exp(-0.75)))


def test_top_drivers(spark):
    row = spark.createDataFrame([(1.0, -3.0, 2.0)], "a double, b double, c double").select(fusion.top_drivers(fusion.linear_contributions({"a": 1, "b": 1, "c": 1}), 2).alias("d")).first()
    assert [(x.feature, x.contribution) for x in row.d] == [("b", -3.0), ("c", 2.0)]


def test_tradeoff(spark):
    out = fusion.tradeoff(
        spark.createDataFrame([("h", 0.9), ("x", 0.8)], "model string, holdout_ap double"), spark.createDataFrame([("h", 1, 2.0), ("x", 1, 1.0)], "model string, batch int, ms double"),
        spark.createDataFrame([("h", 1, ["x"]), ("x", 10, [])], "model string, bytes long, components array<string>"),
    ).collect()
    assert [(r.model, r.bytes) for r in out] == [("h", 11), ("x", 10)]


def gradient_error(model, data, y):
    z, tape = model.forward(data)
    grads = model.backward(tape, neural.sigmoid(z) - y)
    loss = lambda: float((np.logaddexp(0, model.forward(data)[0]) - y * model.forward(data)[0]).sum())
    worst = 0.0
    for k, w in model.w.items():
        at = np.unravel_index(np.argmax(np.abs(grads[k])), w.shape)
        kept = w[at]
        w[at] = kept + 1e-5
        up = loss()
        w[at] = kept - 1e-5
        down = loss()
        w[at] = kept
        worst = max(worst, abs((up - down) / 2e-5 - grads[k][at]) / (abs(grads[k][at]) + 1e-6))
    return worst


def test_gradients():
    draw = np.random.default_rng(0)
    config = neural.TrainConfig(hidden=(5, 4))
    y = np.array([0, 1, 1, 0, 1, 0])
    assert gradient_error(neural.FeedForward(3, config), draw.normal(size=(6, 3)), y) < 1e-3
    x = draw.normal(size=(6, 4, 3))
    assert gradient_error(neural.Recurrent(3, neural.TrainConfig(hidden=(5, 4, 3))), (x, np.array([1, 2, 3, 4, 4, 2])), y) < 1e-3
    with pytest.raises(ValueError):
        neural.Recurrent(3, config).forward((x, np.array([0, 1, 1, 1, 1, 1])))


def test_training_learns():
    draw = np.random.default_rng(0)
    x = draw.normal(size=(600, 4))
    y = (x[:, 0] + 0.2 * draw.normal(size=600) > 0.8).astype(int)
    config = neural.TrainConfig(hidden=(16,), epochs=15, rate=0.01)
    fitted = neural.train(lambda: neural.FeedForward(4, config), x[:400], y[:400], x[400:], y[400:], config)
    assert fitted.best > 0.8
    rows = neural.sampled_rows(np.array([0] * 90 + [1] * 10), 3, np.random.default_rng(1))
    assert len(rows) == 40 and len(set(rows)) == 40


def test_search_and_explanations(spark, tmp_path):
    draw = np.random.default_rng(2)
    x = draw.normal(size=(300, 2))
    rows = spark.createDataFrame([(Vectors.dense(*map(float, r)), int(r[0] > 0.5)) for r in x], ["features", "label"]).withColumn("label", F.col("label").cast("int"))
    found = models.search("logistic", rows, rows, rows, tries=2)
    assert found.report["holdout"]["average_precision"] > 0.9 and found.report["holdout"]["threshold"] == found.report["validation"]["threshold"]
    models.save(found.model, str(tmp_path / "m"))
    assert models.load(str(tmp_path / "m")).transform(rows).count() == 300
    top = rows.select(models.linear_drivers(found.model, ["a", "b"], 1).alias("d")).first().d
    assert top[0].feature in ("a", "b")
    boosted = models.fit("boosted", {"rounds": 3, "depth": 2, "rate": 0.1}, rows)
    assert max(models.tree_drivers(boosted, ["a", "b"])([2.0, 0.0]).items(), key=lambda i: i[1])[0] == "a"
    assert models.sampled_parameters("forest", 3) == models.sampled_parameters("forest", 3)
    with pytest.raises(ValueError):
        models.estimator("other", {})
