"""What has to grow with its input and not with its square, and limits that large tables passed."""

import re

import pytest
from pyspark.sql import functions as F

from tallystream.operators.velocity import VelocityConfig, add_velocity
from tallystream.plans import tables
from tallystream.streaming.activity import state_snapshot, velocity_from_snapshot

CONFIG = VelocityConfig((10, 50), "who", "t", "amount")


def plan(df):
    return df._jdf.queryExecution().toString()


def test_activity_from_a_state_has_no_bounded_frames(spark):
    rows = spark.range(600).select("id", F.when(F.col("id") % 3 > 0, F.lit("a")).alias("who"), F.floor(F.col("id") / 2).alias("t"), (F.col("id") % 7 + 0.25).alias("amount"))
    late = rows.filter("t >= 150")
    out = velocity_from_snapshot(late, state_snapshot(rows.filter("t < 150"), CONFIG), CONFIG)
    frames = re.findall(r"specifiedwindowframe\(RangeFrame, ([^,]+),", plan(out))
    assert frames and all("unbounded" in f for f in frames)
    assert sorted(out.collect()) == sorted(add_velocity(rows, CONFIG).filter("t >= 150").collect())


def test_times_of_shares_are_exact_without_an_aggregate_of_all_values(spark):
    rows = spark.range(1001).select((F.col("id") * F.col("id")).alias("t"))
    assert tables.times_at(rows, (0.25, 0.7)) == pytest.approx(list(rows.agg(F.percentile("t", F.array(F.lit(0.25), F.lit(0.7)))).first()[0]))


def test_shares_of_very_many_customers_are_a_table(spark, tmp_path, monkeypatch):
    from tallystream.operators import preprocess
    from tallystream.plans import preparing, storage

    rows = spark.range(400).select(
        F.col("id").alias("o_orderkey"), (F.col("id") % 90).alias("o_custkey"), F.when(F.col("id") % 3 == 0, "F").otherwise("O").alias("o_orderstatus"), (F.col("id") * 7 % 100 + 0.5).alias("o_totalprice"),
        F.timestamp_seconds(F.lit(900_000_000) + F.col("id") * 86400).cast("timestamp_ntz").alias("o_orderdate"), F.concat((F.col("id") % 3).cast("string"), F.lit("-P")).alias("o_orderpriority"),
    )
    rows.write.parquet(f"{tmp_path}/orders.parquet")
    queries = [preparing.QUERIES[q] for q in ("weighted_batch", "frequency_encoding")] + [storage.QUERIES["sampler_roundtrip"]]
    small = [sorted(q(spark, str(tmp_path)).collect()) for q in queries]
    monkeypatch.setitem(preprocess.fit.__kwdefaults__, "share_limit", 50)
    assert [sorted(q(spark, str(tmp_path)).collect()) for q in queries] == small


def test_first_reviews_of_one_time_are_the_same_for_all_orders_of_rows(spark):
    from tallystream.sources import ledger

    rows = spark.createDataFrame([("u", 5, 5, float(v), f"x{9 - v}", "a") for v in range(8)], "id string, at long, created long, value double, text string, label string")
    for order in ("value", "-value", "pmod(hash(value), 97)"):
        ranked = rows.orderBy(F.expr(order)).coalesce(1)
        merged = ledger.merge(ranked, ranked.limit(0), key="id", at="at", created="created", label="label", fixed=["value", "text"]).first()
        assert (merged["value"], merged["text"]) == (0.0, "x9")


def test_histories_of_rows_count_each_row_of_a_second():
    from tallystream.streaming.histories import HistoryState

    state = HistoryState(3, shared=False)
    assert [state.advance(t, str(i), i) for i, t in enumerate((7, 7, 7, 8))] == [[0], [0, 1], [0, 1, 2], [1, 2, 3]]
    assert [HistoryState(3).advance(7, "a", 1), HistoryState(1, shared=False).advance(7, "b", 2)] == [[1], [2]]


def test_synthetic_rows_of_a_large_table(spark):
    from tallystream.operators import imbalance

    rows = spark.range(2_100_008).select("id", (F.col("id") < 8).cast("int").alias("y"), (F.col("id") % 100).cast("double").alias("v"))
    out = imbalance.smotenc(rows, "y", "id", ["v"], [], imbalance.ImbalanceConfig("smotenc", 2e-5))
    assert imbalance.counts(out, "y") == (2_100_000, 42)


def test_a_step_of_training_costs_little_beside_its_gradients():
    import math
    import time

    import numpy as np

    from tallystream.operators import averaging, neural

    x = np.concatenate([np.linspace(-8, 8, 40_001), [0.0, 30.0, -30.0]])
    assert np.abs(neural._erf(x) - [math.erf(v) for v in x]).max() < 2e-15
    sent = {f"w{i}": np.arange(12.0).reshape(3, 4) for i in range(6)} | {"rows": np.array(7)}
    back = averaging._unpacked(averaging._packed(sent))
    assert list(back) == list(sent) and all((back[k] == sent[k]).all() and back[k].shape == sent[k].shape for k in sent)
    start = time.perf_counter()
    for _ in range(200):
        averaging._unpacked(averaging._packed(sent))
    assert time.perf_counter() - start < 0.1


def test_chunks_share_only_what_windows_reach(spark, monkeypatch):
    from tallystream.operators import velocity

    rows = spark.range(4000).select("id", (F.col("id") % 3).alias("who"), F.floor(F.col("id") / 2).alias("t"), (F.col("id") % 7 + 0.25).alias("amount"))
    given, plain = [], velocity.add_velocity
    want = sorted(plain(rows, CONFIG).collect())
    monkeypatch.setattr(velocity, "add_velocity", lambda df, *a, **k: given.append(df) or plain(df, *a, **k))
    assert sorted(velocity._in_chunks(rows, CONFIG, 500, True).collect()) == want
    assert given[0].count() <= 1.15 * 4000


def test_slots_that_were_never_stored_are_not_removed_from_the_store():
    from tallystream.streaming.keyed import Activity

    stored, calls = {}, []
    make = lambda head: Activity((100,), 10, head, lambda n: calls.append(("load", n)) or stored.get(n), stored.__setitem__, lambda n: calls.append(("drop", n)) or stored.pop(n))
    first = make(None)
    for t in range(0, 1000, 7):
        first.add(t, 1)
    assert not calls
    first.flush()
    second = make(first.head())
    kept = set(stored)
    second.add(5000, 1)
    assert {n for kind, n in calls if kind == "drop"} == kept and not stored


def alike(spark, n):
    y = (F.col("id") % 7 * 3 + F.col("id") % 5 + F.pmod(F.xxhash64("id"), F.lit(9)) > 16).cast("int")
    return spark.range(n).select(F.col("id").cast("string").alias("key"), y.alias("label"), (F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b"))


def test_boosted_trees_are_grown_on_groups_of_alike_rows(spark, monkeypatch):
    from tallystream.operators import boosting, metrics

    rows, seen, plain = alike(spark, 3000), [], boosting._grow
    config = boosting.BoostConfig(rounds=4, together=2, depth=2, bins=8)
    monkeypatch.setattr(boosting, "_grow", lambda table, *a: seen.append(table.count()) or plain(table, *a))
    found = boosting.fit_boosted(rows, rows, ["a", "b"], config=config)
    assert len(seen) == 4 and max(seen) <= 7 * 5 * 2
    monkeypatch.setattr(boosting, "ROUNDS", 2)  # draws of further rounds are counted in a pass of their own
    again = boosting.fit_boosted(rows, rows, ["a", "b"], config=config)
    assert again.model.to_dict() == found.model.to_dict() and again.history == found.history
    counts = rows.groupBy("label", "a").agg(F.count("*").alias("n")).withColumn("p", F.col("a") / 10)
    whole = metrics.average_precision(rows.withColumn("p", F.col("a") / 10), "label", "p").first()[0]
    assert metrics.average_precision(counts, "label", "p", count="n").first()[0] == pytest.approx(whole, abs=1e-12)


def test_forests_are_fitted_on_groups_of_alike_rows(spark, monkeypatch):
    from pyspark.ml.feature import VectorAssembler

    from tallystream.operators import forest

    class Counted(forest.RandomForestClassifier):
        def fit(self, rows):
            seen.append(rows.count())
            return super().fit(rows)

    rows, seen = VectorAssembler(inputCols=["a", "b"], outputCol="features").transform(alike(spark, 3000)), []
    monkeypatch.setattr(forest, "RandomForestClassifier", Counted)
    found = forest.fit_forest(rows, trees=2, depth=3, leaf=2, key="key")
    assert len(seen) == 2 and max(seen) <= 2 * 7 * 5 * 2
    assert {int(f) for t in found.trees for f in t.feature} <= {-1, 0, 1}
    assert all(v in {i + 0.5 for i in range(6)} for t in found.trees for v in t.threshold[t.feature >= 0])


def test_the_first_review_of_a_second_is_the_first_by_full_time(spark, tmp_path):
    from tallystream.plans import quality

    rows = [(e, 1_700_000_000_000_000 + us, e % 2, float(v)) for e, (us, v) in enumerate([(0, 1), (10, 9), (400, 0.5), (500, 3), (3_000_000, 0), (900_000, 2)])]
    made = spark.createDataFrame(rows, "event_id long, us long, user_id long, value double")
    made.select("event_id", F.timestamp_micros("us").cast("timestamp_ntz").alias("ts"), "user_id", F.lit("view").alias("event_type"), "value", F.lit("{}").alias("props")).write.parquet(f"{tmp_path}/events.parquet")
    for q in ("feedback_merge", "feedback_latest"):
        assert quality.QUERIES[q](spark, str(tmp_path)).count() == 2
    assert {r["user_id"]: r["value"] for r in quality.feedback_merge(spark, str(tmp_path)).collect()} == {0: 1.0, 1: 9.0}
