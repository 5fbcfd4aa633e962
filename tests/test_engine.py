import numpy as np
import pytest
from pyspark.sql import functions as F

from tallystream.operators import engine, fusion, neural, transactions
from tallystream.operators.boosting import BoostConfig, fit_boosted
from tallystream.operators.engine import COMPONENTS, Engine, ScoringChain
from tallystream.sources import artifacts, files
from test_runtime import submitted
from test_transactions import raw

LENGTH = 4


@pytest.fixture(scope="module")
def made(spark, tmp_path_factory):
    """A folder with an engine and its chain over 100 past transactions, and the documents."""
    folder = f"file://{tmp_path_factory.mktemp('engine')}"
    matrix, fitted = transactions.model_table(raw(spark, 100), raw(spark, 30, 100))
    names = fitted.names()
    train = matrix.withColumn("key", F.col("row_idx").cast("string"))
    config = BoostConfig(rounds=3, depth=2, child_weight=0.1, together=3, bins=8)
    boosted = fit_boosted(train.filter("partition = 'train'"), train.filter("partition <> 'train'"), names, config=config).model
    dense, recurrent = neural.FeedForward(len(names), neural.TrainConfig(hidden=(6,))), neural.Recurrent(len(names), neural.TrainConfig(hidden=(5, 5)))
    documents = {"boosted": boosted.to_dict(), "feed_forward": neural.to_dict(dense, names), "recurrent": neural.to_dict(recurrent, names)}
    blend = fusion.Hybrid({"boosted": 0.5, "feed_forward": 0.2, "recurrent": 0.3}, "logit", 0.4)
    hybrid = engine.save(folder, documents, blend, fitted, length=LENGTH)
    return folder, documents, hybrid, fitted, ScoringChain.build(spark, folder, raw(spark, 100), length=LENGTH, buckets=4)


def test_engines_are_verified(made):
    folder, documents, hybrid, fitted, _ = made
    assert Engine.load(folder, LENGTH, fitted.names()).document == hybrid
    for wrong in (
        {k: documents[k] for k in COMPONENTS[:2]}, documents | {"recurrent": documents["feed_forward"]}, documents | {"boosted": artifacts.sealed(documents["boosted"] | {"base": 1.0})},
        documents | {"boosted": documents["boosted"] | {"base": 1.0}},
    ):
        with pytest.raises(ValueError):
            Engine.of(wrong, hybrid, LENGTH)
    with pytest.raises(ValueError, match="inputs"):
        Engine.load(folder, LENGTH, fitted.names()[1:])
    with pytest.raises(FileExistsError):
        engine.save(folder, documents, fusion.Hybrid(hybrid["weights"], "logit", 0.4), fitted, length=LENGTH)


def test_chain(spark, made):
    folder, *_, fitted, chain = made
    matrix = {}
    for r in transactions.model_table(raw(spark, 100), raw(spark, 30, 100))[0].collect():
        matrix[r.row_idx] = np.array([r[n] for n in fitted.names()])
    times = {r.row_idx if i < 100 else r.row_idx + 100: (r.cc_num, r.unix_time) for i, r in enumerate(raw(spark, 100).collect() + raw(spark, 30, 100).collect())}
    # The chain's own preprocessor transforms past and new rows alike, so a history is the vectors of the rows before.
    new = submitted(spark, 30, 100)
    part = lambda low, high: new.filter(F.substring("trans_num", 2, 9).cast("int").between(low, high))
    session = chain.session()
    preview = {r.transaction.trans_num: r for r in session.score(part(100, 109), commit=False).collect()}
    first = {r.transaction.trans_num: r for r in session.score(part(100, 109)).collect()}
    second = {r.transaction.trans_num: r for r in session.score(part(110, 117)).collect()}
    assert {k: v.prediction_id for k, v in preview.items()} == {k: v.prediction_id for k, v in first.items()} and session.rows == 18
    for number in range(100, 110):
        row = first[f"k{number}"]
        card, at = times[number]
        before = sorted((t, i) for i, (c, t) in times.items() if c == card and t < at)[-(LENGTH - 1) :]
        assert row.context_depth == len(before) + 1 and row.history_mode == "continued"
        assert row.engineered_features.cc_txn_count_prior == sum(c == card and t < at for c, t in times.values())
        history = np.stack([*[matrix[i] for _, i in before], matrix[number]])
        want = chain.engine.predict(history[-1:], [history])
        got = row.component_probabilities.asDict()
        assert all(got[n] == pytest.approx(want[n][0], abs=1e-6) for n in COMPONENTS)
        logit = sum(w * np.log(got[n] / (1 - got[n])) for n, w in chain.engine.blend.weights.items())
        assert row.fraud_probability == pytest.approx(1 / (1 + np.exp(-logit))) and row.fraud_flag == (row.fraud_probability >= 0.4)
        own = chain.engine.boosted.contributions(history[-1:])[0]
        assert [d.contribution for d in row.top_drivers] == pytest.approx(sorted(own, key=abs, reverse=True)[: len(row.top_drivers)], abs=1e-9)
    assert all(r.context_depth == LENGTH for r in second.values())
    cold = part(118, 119).withColumn("cc_num", F.lit("new"))
    fresh = session.score(cold).orderBy("context_depth").collect()
    assert [(r.history_mode, r.context_depth) for r in fresh] == [("cold_start", 1), ("cold_start", 2)]
    ids = [r.prediction_id for r in fresh]
    assert session.result(ids).count() == 2
    with pytest.raises(ValueError, match="before"):
        session.score(part(117, 117))
    again = ScoringChain.load(spark, folder).session()  # another session goes on from what was committed
    assert again.store.at.number == 3 and again.rows == 0
    session.reset()
    assert session.rows == 0


def test_chains_are_verified(spark, made, tmp_path):
    folder, documents, hybrid, fitted, _ = made
    names = [n for n in files.names(folder) if n.endswith(("json", "gz"))]
    changes = {
        "hybrid.json": fusion.Hybrid(hybrid["weights"], "logit", 0.5).to_dict(hybrid["components"]),
        "preprocessor.json.gz": artifacts.sealed(fitted.to_dict() | {"rows": 1}),
        "runtime.json": artifacts.sealed(artifacts.read_json(f"{folder}/runtime.json") | {"length": LENGTH, "states": "0" * 64}),
    }
    for change, document in changes.items():
        other = f"file://{tmp_path}/{change.split('.')[0]}"
        for n in names:
            artifacts.write_json(f"{other}/{n}", document if n == change else artifacts.read_json(f"{folder}/{n}"))
        for n in files.names(f"{folder}/states/versions"):
            files.write_once(f"{other}/states/versions/{n}", files.read(f"{folder}/states/versions/{n}"))
        with pytest.raises(ValueError, match="not those of the scoring chain"):
            ScoringChain.load(spark, other)
