import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.operators import averaging, neural
from tallystream.operators.averaging import Moves, averaged, epoch_rows, gradients, train_on_all
from tallystream.operators.neural import FeedForward, Recurrent, TrainConfig

INPUTS = ["a", "b.c"]


def table(spark, n, seed):
    draw = np.random.default_rng(seed)
    x = draw.normal(size=(n, 2))
    y = (draw.random(n) < 1 / (1 + np.exp(2 - 3 * x[:, 0] * (x[:, 1] > 0)))).astype(int)
    return spark.createDataFrame([(f"k{i}", int(y[i]), *map(float, x[i])) for i in range(n)], "key string, label int, a double, `b.c` double")


def test_tasks_take_the_steps_of_one_machine(spark):
    """The same epochs by hand: in step s all tasks' batches of that step together."""
    config = TrainConfig(hidden=(5,), dropout=0.0, epochs=2, batch=16, negatives=1.5, rate=0.01)
    rows = table(spark, 400, 1)
    found = train_on_all(lambda: FeedForward(2, config), rows, table(spark, 200, 2), config, inputs=INPUTS, tasks=3)
    model = FeedForward(2, config)
    moves = Moves(model.w, config)
    source = rows.select(F.col("label").alias("y"), F.col("key"), "a", F.col("`b.c`").alias("b"))
    counts = tuple(source.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first())
    weights = []
    for epoch in range(2):
        drawn, positive = epoch_rows(source, config.negatives, counts, config.seed, epoch)
        data = drawn.repartition(3, "order").sortWithinPartitions("order", "key").withColumn("task", F.spark_partition_id()).toPandas()
        assert (data["y"] == 1).sum() == counts[1] and (data["y"] == 0).sum() == pytest.approx(1.5 * counts[1], rel=0.25)
        parts = [g[["a", "b", "y"]].to_numpy() for _, g in data.groupby("task")]
        for step in range(max(-(-len(p) // 16) for p in parts)):
            now = np.concatenate([p[16 * step : 16 * step + 16] for p in parts])
            total = gradients(model, now[:, :2], now[:, 2], positive, None)
            moves.apply(model.w, {k: g / len(now) for k, g in total.items()})
        weights.append({k: w.copy() for k, w in model.w.items()})
    best = weights[int(np.argmax(found.history))]
    assert found.epochs == 2 and all(found.model.w[k] == pytest.approx(best[k], abs=1e-9) for k in best)


def test_negatives_are_drawn_anew(spark):
    rows = table(spark, 600, 3).select(F.col("label").alias("y"), "key")
    counts = tuple(rows.agg(F.count_if(F.col("y") == 0), F.count_if(F.col("y") == 1)).first())
    first, second = ({r.key for r in epoch_rows(rows, 1.0, counts, 7, e)[0].filter("y = 0").collect()} for e in (0, 1))
    assert first and second and first != second and epoch_rows(rows, 99.0, counts, 7, 0)[0].count() == 600


def test_networks_learn_and_stop(spark):
    config = TrainConfig(hidden=(8,), dropout=0.1, epochs=12, patience=2, batch=64, rate=0.02)
    train, valid = table(spark, 3000, 4), table(spark, 800, 5)
    found = train_on_all(lambda: FeedForward(2, config), train, valid, config, inputs=INPUTS, tasks=2)
    data = valid.toPandas()
    share, own = data["label"].mean(), neural.average_precision(data["label"].to_numpy(), found.model.predict(data[INPUTS].to_numpy()))
    assert own == pytest.approx(found.best, abs=1e-9) and own > 2 * share and found.best == max(found.history)
    assert found.epochs == 12 or found.history.index(max(found.history)) == found.epochs - 3


def test_histories(spark):
    config = TrainConfig(hidden=(4, 4), dropout=0.0, epochs=2, batch=32)
    draw = np.random.default_rng(6)
    rows = [(f"k{i}", int(h[-1][0] > 0.5), h) for i in range(200) for h in [draw.normal(size=(1 + i % 3, 2)).tolist()]]
    df = spark.createDataFrame(rows, "key string, label int, history array<array<double>>")
    found = train_on_all(lambda: Recurrent(2, config), df, df, config, inputs=["history"], length=3, tasks=2)
    assert found.epochs == 2 and all(0 < h <= 1 for h in found.history)


def test_messages_and_odd_tables(spark):
    assert averaged([b"", b""]) is None
    one = averaging._packed({"a": np.array([2.0, 4.0]), "rows": np.array(2)})
    assert averaged([one, b"", one])["a"].tolist() == [1.0, 2.0]
    rows = table(spark, 50, 1)
    with pytest.raises(ValueError, match="classes"):
        train_on_all(lambda: FeedForward(2, TrainConfig()), rows.filter("label = 0"), rows, TrainConfig(), inputs=INPUTS)


def test_ranges_are_put_in_order_before_the_tasks_that_train(spark, monkeypatch):
    """However many ranges there are, the same steps are made; what the tasks get is chunks."""
    config = TrainConfig(hidden=(5,), dropout=0.1, epochs=2, batch=16, negatives=1.5, rate=0.01)
    rows, seen, plain = table(spark, 3000, 1), [], averaging._dealt
    monkeypatch.setattr(averaging, "_dealt", lambda *a: seen.append(plain(*a)) or seen[-1])
    fits = []
    for size in (10_000, 100):
        monkeypatch.setattr(averaging, "RANGE", size)
        fits.append(train_on_all(lambda: FeedForward(2, config), rows, table(spark, 200, 2), config, inputs=INPUTS, tasks=2))
    first, second = fits
    assert first.history == second.history and all((first.model.w[k] == second.model.w[k]).all() for k in first.model.w)
    assert [df.columns for df in seen] == [["chunk"]] * 4


def test_scores_of_blocks_are_those_of_all_rows():
    model, x = FeedForward(3, TrainConfig(hidden=(4,))), np.random.default_rng(3).normal(size=(2 * neural.BLOCK + 5, 3))
    assert model.predict(x) == pytest.approx(neural.sigmoid(model.forward(x)[0]), abs=1e-12) and model.predict(x[:0]).shape == (0,)
